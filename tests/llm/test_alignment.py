import hashlib
from collections import Counter, defaultdict

import pytest

from glyphmill.llm import alignment
from glyphmill.llm.queries import BYTE_MODEL, table, tokenizer_path

A, B = BYTE_MODEL, "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
    spell = {}
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    for x in plain:
        spell[chr(x)] = x
    for k, x in enumerate(sorted(set(range(256)) - set(plain))):
        spell[chr(256 + k)] = x

    def of(text):
        """Both tokenizers' ids with their bytes, of the whole text at once."""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        one = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
        return [(i, bytes(spell[c] for c in a.id_to_token(i))) for i in ids_a], [(i, one(b.id_to_piece(i))) for i in ids_b]

    return of


def brute(docs, of):
    """The contract's columns, token by token and pair by pair."""
    found, held = [], defaultdict(set)
    for n, (_, text) in enumerate(docs):
        a, b = of(text) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            found.append(None)
            continue
        place = lambda ts: [(i, sum(len(x) for _, x in ts[:k]), sum(len(x) for _, x in ts[: k + 1])) for k, (i, _) in enumerate(ts)]
        a, b = place(a), place(b)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, begin = [], 0
        for end in cuts:
            part = lambda ts: ",".join(str(i) for i, s, e in ts if begin <= s and e <= end)  # noqa: B023, E731
            groups.append(f"{part(a)}|{part(b)}")
            begin = end
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        for p in set(links):
            held[p].add(n)
        found.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (i, _), rows in held.items():
        best[i] = max(best[i], len(rows))
    out = []
    for (i, _), x in zip(docs, found):
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = x
            counts = [len(held[p]) for p in links]
            out.append((i, n_a, n_b, len(groups), len(links), sum(c == best[p[0]] for p, c in zip(links, counts)), sum(counts), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


TEXTS = [
    None, "", " ", "a", "a ", " a", "a  b", "a \n b", "\n\n", "word, word. Word's", "a b c　d   e", "▁", "x ▁y z", "x y", "<|endoftext|> <s> </s> <unk> <0x41>",
    "日本語のテキスト と 한국어", "🙂🙂 é ﬁ Å", "\t tab\r\nline", "a\x00b \x1c c", "\x85 n", "éèê " * 50, "aaaa" * 200, "1234567 89,01 0.5", "don't we'll I'M",
    "Kbİ ß", "w" * 3000 + " end", "the the the the",
]


@pytest.mark.parametrize("most", [2_000_000, 40])
def test_equals_brute_force(spark, docs_of, tokenizers, most):
    rows = [*enumerate(TEXTS), (3, "a"), (3, "a"), (None, "the end")]
    out = alignment.align(docs_of(rows).repartition(3), tokenizer_path(A), tokenizer_path(B), most_pairs=most)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(brute(rows, tokenizers), key=repr)


def test_whole_table(spark, small_dir, tokenizers):
    docs = table(spark, small_dir, "documents").where("length(text) < 3000")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], tokenizers)
    assert sorted(map(tuple, alignment.align(docs, tokenizer_path(A), tokenizer_path(B)).collect())) == sorted(want)


def test_groups_and_links_are_kept(spark, docs_of, tokenizers):
    row = alignment.link(docs_of([(1, "Ununited words")]), tokenizer_path(A), tokenizer_path(B)).first()
    a, b = tokenizers("Ununited words")
    assert [int(x) for g in row.groups.split(";") for x in g.split("|")[0].split(",")] == [i for i, _ in a]
    assert [int(x) for g in row.groups.split(";") for x in g.split("|")[1].split(",")] == [i for i, _ in b]
    assert sum(row.times) == row.n_links and Counter(row.pairs).most_common(1)[0][1] == 1


def test_tables(spark, docs_of):
    assert alignment.align(docs_of([]), tokenizer_path(A), tokenizer_path(B)).count() == 0
    clash = docs_of([(1, "a b")]).selectExpr("doc_id", "text", "1 as pairs", "2 as times", "3 as n", "4 as groups", "5 as n_a")
    assert alignment.align(clash, tokenizer_path(A), tokenizer_path(B)).first().n_a == 2
