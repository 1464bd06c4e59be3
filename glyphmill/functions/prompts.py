"""What a model is asked: to answer from a context, to choose a passage, or to write an answer anew."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Templates by language; ``{context}`` and ``{question}`` are filled in.  The language is demanded last, where it weighs most.
ANSWER = {
    "fr": (
        "Réponds à la question en te fondant sur les seuls extraits suivants. S'ils n'y répondent pas, écris : "
        "« Il n'y a pas assez d'informations dans les documents. »\n\nExtraits :\n{context}\n\nQuestion : {question}\n\n"
        "Les extraits sont en arabe, la réponse doit être entièrement en français.\n\nRéponse :"
    ),
    "ar": (
        "أجب عن السؤال بالاعتماد على المقتطفات الآتية وحدها. فإن لم تجب عنه فاكتب: «لا توجد معلومات كافية في الوثائق».\n\n"
        "المقتطفات:\n{context}\n\nالسؤال: {question}\n\nاكتب الجواب كله بالعربية.\n\nالجواب:"
    ),
}
#: Put before the demand for a language where every claim must cite the context.
CITE = {
    "fr": "Après chaque affirmation, recopie entre [[ et ]] le passage exact des extraits qui la fonde.\n\n",
    "ar": "بعد كل معلومة انسخ بين [[ و ]] العبارة التي تدل عليها من المقتطفات بلفظها.\n\n",
}
_DEMAND = {"fr": "Les extraits sont", "ar": "اكتب الجواب كله"}
CHOICE = {
    "fr": "Voici des passages, chacun avec son étiquette.\n\n{context}\n\nQuestion : {question}\n\n{form} Ne copie rien des passages, n'explique rien.\n\nChoix :",
    "ar": "هذه مقاطع لكل منها وسم.\n\n{context}\n\nالسؤال: {question}\n\n{form} لا تنقل شيئا من المقاطع ولا تشرح.\n\nالاختيار:",
}
#: How the choice is to be written, by language, and whether as JSON: ``{what}`` is what labels a passage.
FORM = {
    ("fr", True): 'Donne un objet JSON {"passage": N} : N est {what} du passage qui répond à la question, 0 si aucun n\'y répond.',
    ("fr", False): "Donne seulement {what} du passage qui répond à la question, 0 si aucun n'y répond.",
    ("ar", True): 'أعط كائن JSON {"passage": N}، حيث N هو {what} الذي فيه الجواب، أو 0 إن لم يكن في أي مقطع.',
    ("ar", False): "اكتب {what} الذي فيه الجواب وحده، أو 0 إن لم يكن في أي مقطع.",
}
WHAT = {("fr", True): "la lettre", ("fr", False): "le numéro", ("ar", True): "حرف المقطع", ("ar", False): "رقم المقطع"}
REPAIR = {
    "fr": "Cette réponse n'est pas en français. Récris-la tout entière en français, sans rien ajouter ni retirer.",
    "ar": "هذا الجواب ليس بالعربية. أعد كتابته كله بالعربية من غير زيادة ولا نقص.",
}


def _filled(template: str, **values: Column) -> Column:
    """A template with its fields filled in from columns (null counts as empty); no field is looked for in what is filled in."""
    parts, at = [], 0
    places = sorted((template.index(f"{{{name}}}"), name) for name in values)
    for place, name in places:
        parts += [F.lit(template[at:place]), F.coalesce(values[name], F.lit(""))]
        at = place + len(name) + 2
    return F.concat(*parts, F.lit(template[at:]))


def answer_template(language: str = "ar", cite: bool = False) -> str:
    text = ANSWER[language]
    return text.replace(_DEMAND[language], CITE[language] + _DEMAND[language]) if cite else text


def answer_prompt(question: Column, context: Column, language: str = "ar", cite: bool = False) -> Column:
    """Asks for an answer in ``language`` from the context alone; with ``cite``, for a quotation behind each claim."""
    return _filled(answer_template(language, cite), context=context, question=question)


def choice_template(language: str = "ar", letters: bool = False, as_json: bool = True) -> str:
    return CHOICE[language].replace("{form}", FORM[language, as_json].replace("{what}", WHAT[language, letters]))


def choice_prompt(question: Column, passages: Column, language: str = "ar", letters: bool = False, as_json: bool = True) -> Column:
    """Asks for the label of the passage that answers, or 0; ``passages`` are the numbered blocks."""
    return _filled(choice_template(language, letters, as_json), context=passages, question=question)


def messages(question: Column, context: Column, language: str = "ar", previous: Column | None = None, cite: bool = False) -> Column:
    """The conversation ``(role, content)`` to send: the prompt, and where there is a previous answer, that and what to mend."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    asked = F.array(say("user", answer_prompt(question, context, language, cite)))
    if previous is None:
        return asked
    again = F.array(say("assistant", previous), say("user", F.lit(REPAIR[language])))
    return F.when(F.coalesce(previous, F.lit("")) != "", F.concat(asked, again)).otherwise(asked)
