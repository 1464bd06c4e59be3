"""Citations, excerpts, and French numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.text import strip, strip_end

# The words of a citation by language.
PAGE = {"fr": ("page ", " (lignes ", ", "), "ar": ("صفحة ", " (الأسطر ", "، ")}
SELECTED = {"fr": "Passage sélectionné dans l'ouvrage (à vérifier) :", "ar": "المقطع المختار من الكتاب (يُرجى التحقّق منه):"}
EXCERPTS = {"fr": "📄 Extraits cités :", "ar": "📄 المقتطفات:"}


def source_label(s: Column) -> Column:
    """A work's title, else its file, else nothing."""
    return F.coalesce(F.nullif(strip(s["title"]), F.lit("")), s["source"], F.lit(""))


def _place(s: Column, language: str) -> Column:
    page, lines, _ = PAGE[language]
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat(F.lit(page), text(s["page"]), F.lit(lines), text(s["line_start"]), F.lit("-"), text(s["line_end"]), F.lit(")"))


def format_sources(sources: Column, language: str = "ar") -> Column:
    """All citations of an array of sources in order; a work named right before isn't named again."""
    named = F.transform(sources, source_label)
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(named, 1, F.greatest(F.size(named) - 1, F.lit(0))))

    def one(s: Column, i: Column) -> Column:
        name = F.get(named, i)
        prefix = F.when((name != "") & ~F.coalesce(name == F.get(before, i), F.lit(False)), F.concat(name, F.lit(" — "))).otherwise("")
        return F.concat(prefix, _place(s, language))

    return F.array_join(F.transform(sources, one), PAGE[language][2])


def format_excerpts(passages: Column, sources: Column, language: str = "ar", most: int = 200) -> Column:
    """A numbered list of passages, each cut to ``most`` characters with an ellipsis, and its citation."""

    def one(p: Column, i: Column) -> Column:
        text = F.replace(strip(p["text"]), F.lit("\n"), F.lit(" "))
        text = F.when(F.length(text) > most, F.concat(strip_end(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)
        return F.concat((i + 1).cast("string"), F.lit(". « "), text, F.lit(" » — "), format_sources(F.array(p["s"]), language))

    rows = F.arrays_zip(passages.alias("text"), sources.alias("s"))
    return F.concat(F.lit(EXCERPTS[language] + "\n"), F.array_join(F.transform(rows, one), "\n"))


def format_chosen(passage: Column, source: Column, language: str = "ar") -> Column:
    return F.concat(F.lit(SELECTED[language] + "\n\n"), strip(passage), F.lit("\n\n"), format_sources(F.array(source), language))


def examples(items: Column, most: int = 5) -> Column:
    """The first items, and how many more there are."""
    more = F.when(F.size(items) > most, F.concat(F.lit(" (+"), (F.size(items) - most).cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), more)


def fixed(value: Column, places: int) -> Column:
    """A number to some places; the double's exact value is rounded, so that 0.35 gives 0.3, and exact halves go to even."""
    return F.call_function("format_number", value.cast("double"), F.lit("0" + ("." + "0" * places if places else "")))


def french_number(value: Column, places: int = 2) -> Column:
    return F.replace(fixed(value, places), F.lit("."), F.lit(","))


def french_percent(value: Column) -> Column:
    return F.concat(french_number(value * 100, 1), F.lit(" %"))


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """``1 question``, ``3 questions``; zero is singular."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n <= 1, one).otherwise(many or one + "s"))


def duration(seconds: Column) -> Column:
    """Seconds below 90, then minutes below 90, hours below 36, then days."""
    minutes, hours = seconds / 60, seconds / 3600
    return (
        F.when(seconds < 90, F.concat(french_number(seconds, 1), F.lit(" s"))).when(minutes < 90, F.concat(fixed(minutes, 0), F.lit(" min")))
        .when(hours < 36, F.concat(french_number(hours, 1), F.lit(" h"))).otherwise(F.concat(french_number(hours / 24, 1), F.lit(" jours")))
    )


def batch_verdict(batch: Column, ms_per_chunk: Column, timeout: Column, margin: float = 5.0) -> Column:
    """``ok`` with the margin asked for, ``thin`` from twice the time, else ``too_slow``; what takes no time is ``ok``."""
    room = F.try_divide(timeout, ms_per_chunk * batch / 1000)  # computed once for both tests, also where the first holds without it
    return F.when((batch * ms_per_chunk <= 0) | (room >= margin), "ok").when(room >= 2, "thin").otherwise("too_slow")


def status_text(status: Column, chunks: Column, seconds: Column) -> Column:
    done = F.concat(chunks.cast("string"), F.lit(" chunks ("), fixed(seconds, 1), F.lit(" s)"))
    return F.when(status == "unchanged", "inchangé, ignoré").when(status == "empty", "aucun texte extractible, ignoré").otherwise(done)
