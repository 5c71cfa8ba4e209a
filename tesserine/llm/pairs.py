"""Broken pairs of question and response, each with its type of defect.

A pair has a question and two response fields (a value and an explanation). Tokens of response and question are aligned by
shingle containment and longest common subsequence to find copies; responses are aligned against refusal templates; empty,
truncated and foreign-language responses are found from placeholders, endings and function words. All texts are judged
row by row in Arrow batches, each by its own row alone; the only shuffle drops repeated rows.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.confusables import prototypes

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
# What stands in a field that was left empty (compared without case, quotes, brackets and dots).
PLACEHOLDERS = frozenset("n/a na none null nil nan tbd tba todo unknown undefined empty missing placeholder - -- --- ? ?? _ k.a. k.a keine sin nd n.d".split() + ["not available", "no answer", "to be determined", "to do"])
# Refusals. "…" stands for up to GAP other words.
GAP = 8
REFUSALS = tuple(
    tuple(t.split())
    for t in (
        "i cannot provide", "i can't provide", "i can't help with", "i cannot help with", "i cannot answer", "i can't answer", "i cannot assist", "i can't assist",
        "i cannot share", "i can't share", "i cannot discuss", "i can't discuss", "i cannot comply", "i can't comply", "i cannot comment", "i can't comment", "i am unable to", "i'm unable to",
        "i'm not able to", "i am not able to", "i won't be", "i will not be giving", "i will not answer", "i must decline", "i have to decline", "i decline to",
        "i do not have permission", "i don't have permission", "i am not allowed to", "i'm not allowed to", "i am not permitted to", "i'm not permitted to",
        "i can not provide", "i can not help", "i can't help", "i cannot help", "i can not answer", "i can not assist", "i can not share", "i can not discuss", "i can not comply", "i can not comment", "i could not help", "i couldn't help with",
        "i will refrain from", "i refrain from", "i must refrain from", "i would rather not", "i'd rather not", "i prefer not to", "i would prefer not to", "i will not provide", "i will not help", "i will not discuss", "i will not comment",
        "i won't answer", "i won't provide", "i won't help", "i won't discuss", "i won't comment", "i refuse to", "i have to refuse", "i must refuse", "i cannot fulfil", "i cannot fulfill", "i can't fulfil", "i can't fulfill", "i cannot respond", "i can't respond", "i cannot disclose", "i can't disclose",
        "would not be appropriate for me", "wouldn't be appropriate for me", "outside what i am allowed", "outside what i'm allowed", "as a language model", "as an ai",
        "kann ich … nicht beantworten", "ich kann … nicht beantworten", "darf ich … keine auskunft", "ich darf … keine auskunft", "kann ich … keine auskunft", "ich kann … keine auskunft",
        "kann ich … nicht helfen", "ich kann … nicht helfen", "ich muss … ablehnen", "muss ich … ablehnen", "bin ich nicht befugt", "ich bin nicht befugt", "als sprachmodell",
        "je ne peux pas répondre", "je ne peux pas vous aider", "je ne peux pas fournir", "je ne suis pas en mesure", "je ne suis pas autorisé", "je refuse de", "je dois refuser", "en tant que modèle de langage",
        "je ne peux pas vous répondre", "je ne peux pas vous fournir", "je ne peux pas donner", "je préfère ne pas répondre", "je ne souhaite pas répondre", "je dois décliner", "ich möchte … nicht beantworten", "ich werde … nicht beantworten", "ich verweigere", "ich lehne … ab",
        "no puedo contestar", "no puedo compartir", "prefiero no responder", "me niego a", "tengo que rechazar", "no quiero responder",
        "non posso rispondere", "non posso aiutare", "non posso aiutarti", "non posso fornire", "non sono in grado di rispondere", "non sono autorizzato", "non sono autorizzata", "devo rifiutare", "come modello linguistico",
        "não posso responder", "não posso ajudar", "não posso fornecer", "não estou autorizado", "não estou autorizada", "devo recusar", "como modelo de linguagem", "ik kan … niet beantwoorden", "ik kan … niet helpen", "ik mag … niet beantwoorden", "als taalmodel",
        "no puedo responder", "no puedo ayudar", "no puedo proporcionar", "no estoy autorizado", "no estoy autorizada", "no tengo permiso", "no me es posible", "debo negarme", "como modelo de lenguaje",
    )
)
_BY_FIRST = {first: tuple(t for t in REFUSALS if t[0] == first) for first in {t[0] for t in REFUSALS}}
ROLES = frozenset(("as", "als", "en", "como", "come"))  # first words of the templates that name a role
SPEAKER = frozenset("i i'm i'd me my ich mir mein je j'ai me yo mi".split())
# Words that hold sentences together, by language; words of two lists count for both.
FUNCTION_WORDS = {
    "en": "the of and for with from that is are was were a an in to by on at each while because until although per its it this these as or which not no between into under what how does do whereas about if until after before",
    "de": "der die das den dem des ein eine einer eines und oder nicht nur sondern auch für mit von auf bei aus zu im in ist sind war wird wenn weil dass laut wie welchen durch gegen ohne um nach danach zwischen keinen keine nennen",
    "fr": "le la les un une des du de et ou pas ne mais pour par sur dans avec sans est sont était qui que selon chaque entre soit ce cette au aux en à contre quelle combien aucune",
    "es": "el la los las un una unos de del y o no pero para por sobre con sin es son que según cada entre en al junto cuánto qué se lo su ningún",
    "pt": "o a os as um uma do da dos das de e ou não mas para por com sem é são que segundo cada entre em no na ao há então isso vem além outra foi",
    "it": "il lo la i gli le un una di del della dei e o non ma per con senza è sono che secondo ogni tra fra in al nel nella da dal si questo quindi viene",
    "nl": "de het een van en of niet maar voor met zonder op bij uit in is zijn was wordt dat die volgens elke tussen naar door om te er aan dus waarde",
    "sv": "och att det som en ett av för med på är inte den till i om från enligt varje mellan utan eller men har därför",
    "pl": "i w na z do nie że się to jest dla po od według każdy oraz przez ale lub jak co więc",
    "cs": "a v na z do ne že se to je pro po od podle každý nebo ale jak co proto",
    "tr": "ve bir bu için ile de da ne olarak göre her veya ama gibi daha çok değer",
}
_LISTS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
# Words and signs a sentence does not end with.
DANGLING = frozenset(
    "the a an of and or with because which is in to for by on at as that under near between although while until from its whereas i.e e.g "
    "der die das den dem des ein eine einer eines einem und oder mit von für im bei weil dass durch um zu gegen ohne "
    "le la les un une des du de et ou avec pour par sur dans parce qui que selon sans "
    "el los las un una unos unas y o con para por porque según del al en sin".split()
)
SHORT = 8  # words of a response that is judged by two function words
NOTE_WORDS = 8  # a note without a final stop is at most this long
# Words that open a clause, never a note; and words that open a sentence as well as a note.
CLAUSES = frozenset(
    "does do did is are was were has have how what which who where when why while whereas because since once if although until unless we they it he she there i you "
    "wenn weil obwohl während sobald falls ob wir sie er es wer wie warum nachdem "
    "est-ce pourquoi comment quand lorsque puisque si bien-que nous ils elles il elle on "
    "cuando aunque mientras porque si nosotros ellos cómo qué cuál quién".split()
)
SUBJECTS = frozenset(
    "the a an this that these those each every its our their der die das den dem ein eine dieser diese dieses jeder jede jedes "
    "le la les un une ce cette ces chaque el los las una unos unas este esta estos estas cada".split()
)
# Words that a note ends in, by language.
NOTE_ENDS = {
    "en": "above abstract abstracts amount amounts annex annexes answer answers appendices appendix article articles average averages below body calculation calculations caption captions chapter chapters chart charts "
    "column columns conclusion conclusions conversion data dataset difference diagram diagrams document documents equation equations estimate estimates figure figures footnote footnotes formula formulas graph graphs here introduction "
    "items legend legends line lines list lists mean median method methods note notes number numbers only page pages paper papers paragraph paragraphs passage passages percent plot plots product quotient range ratio "
    "reference references report reports result results row rows section sections sentence sentences source sources study studies sum summary supplement table tables text total totals unit units value values year years",
    "de": "abbildung abbildungen abschnitt abschnitte absatz angabe angaben anhang anlage artikel bericht differenz diagramm einheit einheiten formel fußnote grafik jahr jahre kapitel legende liste mittel mittelwert oben passage "
    "quelle quellen rechnung seite seiten spalte spalten studie summe tabelle tabellen text unten wert werte zahl zahlen zeile zeilen zusammenfassung",
    "fr": "annexe annexes année années article bas calcul chapitre chiffre chiffres colonne colonnes conclusion dessous dessus document données différence figure figures formule graphique légende ligne lignes liste moyenne note notes "
    "page pages paragraphe passage pied produit rapport résultat résultats résumé section somme source sources tableau tableaux texte total totaux unité unités valeur valeurs étude",
    "es": "abajo anexo apéndice arriba artículo año años capítulo cifra cifras columna columnas cálculo datos diferencia documento estudio fila filas figura figuras fuente fuentes fórmula gráfico informe leyenda lista línea líneas media "
    "nota notas página páginas párrafo pasaje pie producto promedio resultado resultados resumen sección suma tabla tablas texto total totales unidad unidades valor valores",
}
_NOTE_ENDS = {k: frozenset(v.split()) for k, v in NOTE_ENDS.items()}
# Endings of derived words; a longer word with one is whole.
DERIVED = {
    "en": ("tion", "tions", "sion", "sions", "ment", "ments", "ness", "ity", "ities", "ance", "ence", "ings"), "de": ("ung", "ungen", "heit", "heiten", "keit", "keiten", "schaft"),
    "fr": ("tion", "tions", "sion", "sions", "ment", "ments", "ité", "ités"), "es": ("ción", "ciones", "sión", "siones", "dad", "dades", "miento", "mientos"),
}


def clean(text: str | None) -> str:
    """Text without invisible characters and with plain blanks."""
    if text is None:
        return ""
    return text.strip() if text.isascii() else unicodedata.normalize("NFC", text.translate(_seen())).strip()


def _seen() -> dict:
    if not _SEEN:
        _SEEN.update({c: to for c, to in prototypes().items() if to in ("", " ")})
    return _SEEN


_SEEN: dict = {}


def words(text: str) -> list[str]:
    return [w.lower().replace("’", "'") for w in WORD.findall(text)]


def is_empty(text: str) -> bool:
    core = text.strip(" \t\r\n\"'“”‘’«»()[]{}.…").lower()
    return not core or core in PLACEHOLDERS or not any(c.isalnum() for c in core)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over b."""
    where: dict = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - bin(row).count("1")


def contained(a: list, b: list, size: int = 3) -> float:
    """Share of the shingles of a that b has."""
    if len(a) < size:
        return 0.0
    have = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)}
    return sum(tuple(a[i : i + size]) in have for i in range(len(a) - size + 1)) / (len(a) - size + 1)


def is_copy(response: list, question: list) -> bool:
    """The response only repeats the question, once or several times: hardly anything in it is its own, and most of the question is in it."""
    if len(response) < 4 or len(question) < 4:
        return False
    times = max(1, round(len(response) / len(question)))
    if contained(response, question * min(times, 2)) < 0.7:
        return False
    same = common_subsequence(response, question * times)
    return same >= 0.85 * len(response) and same >= 0.7 * len(question)


def is_refusal(response: list, text: str = "") -> bool:
    """A refusal template occurs anywhere in the response (the words of text).

    Templates that name a role ("as an ai") count where they open the response or a sentence of it, or where the speaker
    is named within GAP words after them; a machine may be used "as an ai accelerator".
    """
    opens = None
    for start, word in enumerate(response):
        for template in _BY_FIRST.get(word, ()):
            end = _follows(response, start, template)
            if not end:
                continue
            if word not in ROLES or start == 0 or not SPEAKER.isdisjoint(response[end : end + GAP]):
                return True
            if opens is None:
                opens = _sentence_starts(text)
            if start in opens:
                return True
    return False


def _sentence_starts(text: str) -> set[int]:
    """Numbers of the words that come first after the end of a sentence or a line."""
    starts, before = set(), 0
    for i, m in enumerate(WORD.finditer(text)):
        if re.search(r"[.!?。！？…:\n]", text[before : m.start()]):
            starts.add(i)
        before = m.end()
    return starts


def _follows(tokens: list, start: int, template: tuple) -> int:
    """Where the template ends that begins at start, 0 if it does not."""
    at, gap = start + 1, False
    for t in template[1:]:
        if t == "…":
            gap = True
            continue
        room = tokens[at : at + (GAP if gap else 0) + 1]
        if t not in room:
            return 0
        at, gap = at + room.index(t) + 1, False
    return at


def language_scores(text: str, tokens: list) -> dict[str, float]:
    """Evidence for each language: function words, or everything for the script that holds most of the letters."""
    letters = [c for c in text if c.isalpha()]
    other = [unicodedata.name(c, "?").split()[0] for c in letters if ord(c) > 0x24F]
    if letters and len(other) > 0.3 * len(letters):
        return {"script:" + max(set(other), key=other.count): float(len(tokens) + 3)}
    return {k: float(sum(t in ws for t in tokens)) for k, ws in _LISTS.items()}


def other_language(question: str, response: str) -> bool:
    """The response is in another language than the question: the question's own language clearly is not its best.

    Evidence are function words, three of them at least; in a response of fewer than SHORT words two, and three times as many as of the own language.
    """
    asked = language_scores(question, words(question))
    given_words = words(response)
    given = language_scores(response, given_words)
    mine = max(asked, key=asked.get)
    best = max(given, key=given.get)
    short = len(given_words) < SHORT
    enough = given[best] >= (max(2.0, 3 * given.get(mine, 0.0)) if short else 3)
    return asked[mine] >= 2 and enough and given[best] >= 0.12 * len(given_words) and given.get(mine, 0.0) * 1.3 <= given[best]


def breaks_off(text: str, note_ends_in: str | None = None) -> str | None:
    """'yes', 'no', or 'note' where it turns on whether the last word is one (see broken_pairs)."""
    core = text.rstrip(" \t\r\n\"'“”‘’»")
    if not core:
        return "no"
    if core[-1] in ".!?。！？…":
        return "no"
    tokens = core.split()
    if not core[-1].isalnum() and core[-1] not in ")]%°³²" or text.rstrip().endswith('"') and text.count('"') % 2:
        return "yes"
    last = tokens[-1].strip("()[],;:").lower()
    if last in DANGLING or core.count("(") > core.count(")") or len(tokens) > NOTE_WORDS or re.search(r"[.!?。]\s", core):
        return "yes"
    return "no" if last[-1:].isdigit() else "note"


def _value_breaks_off(value: str, tokens: list) -> bool:
    """A value that is a sentence and has no end; names, amounts and lists need none."""
    if sum(not any(c.isdigit() for c in t) for t in tokens) < 6 or re.search(r"[|;\n\t\[\]\"]", value[:-1]):
        return False
    if sum(t.istitle() or t[:1].isdigit() for t in WORD.findall(value)) > 0.5 * len(tokens):
        return False
    held = sum(any(t in ws for ws in _LISTS.values()) for t in tokens)
    return held >= 2 and breaks_off(value) != "no"


def is_note(question: str, value: str, note: str) -> bool:
    """A short text without a final stop is a whole note and no sentence that was cut off; decided by its own row alone.

    It must not open a clause, and its last word must be a whole one that can end a phrase: a word of the question or of the
    value, a word notes of its language end in, a derived word, or an abbreviation. What begins as a sentence (with an
    article or the like) must end in a word for notes. In languages without such words only what begins a longer
    word of the question is cut off.
    """
    said, asked = words(note), words(question)
    if not said:
        return True
    last = said[-1]
    scores = language_scores(f"{question} {note}", asked + said)
    best = max(scores.values())
    own = [k for k in scores if scores[k] == best]
    if said[0] in CLAUSES:
        return False
    if any(last in _NOTE_ENDS.get(k, ()) for k in own):
        return True
    if said[0] in SUBJECTS or any(last in _LISTS.get(k, ()) for k in own):
        return False
    if last in asked or last in words(value) or re.search(r"\w[A-Z][^\W_]*\W*$", note) or len(last) >= 7 and any(last.endswith(DERIVED.get(k, ())) for k in own):
        return True
    return not any(k in NOTE_ENDS for k in own) and not any(w.startswith(last) for w in asked)


def judge(question: str | None, value: str | None, explanation: str | None, blank: str) -> str | None:
    """Defect of a pair, or None."""
    q, v, e = clean(question), clean(value), clean(explanation)
    if is_empty(v) or is_empty(e):
        return "empty"
    qw, vw, ew = words(q), words(v), words(e)
    label = lambda ws: ws[1:] if ws[:1] and ws[0] in ("question", "q", "frage", "pregunta") else ws
    if is_copy(label(vw), qw) or is_copy(label(ew), qw):
        return "copy"
    if (v != blank and is_refusal(vw, v)) or is_refusal(ew, e):
        return "refusal"
    ends = breaks_off(e)
    if ends == "yes" or (v != blank and _value_breaks_off(v, vw)):
        # a foreign text may use another full stop, but one without any end is cut off in any language
        return "truncated"
    if other_language(q, e):
        return "language"
    return "truncated" if ends == "note" and not is_note(q, v, e) else None


def broken_pairs(
    pairs: DataFrame, key: str = "gen_id", question: str = "question", value: str = "answer_value", explanation: str = "explanation", blank: str = "is_blank"
) -> DataFrame:
    """(key, defect): each defective pair, defect being one of empty, truncated, refusal, copy, language.

    A null question cannot be copied and has no language; null responses are empty. `blank` is the value of an abstention:
    with it the explanation says what is missing, which is neither empty nor a refusal. A short explanation without a final
    stop is a note and sound, unless it opens a clause or its last word is cut off (see is_note); other rows do not count
    for that, so a row has the same defect in every table. Repeated
    rows count once, rows with a null key take no part, an empty table gives an empty result, other columns are ignored.
    """
    kind = dict(pairs.dtypes)[key]
    rows = pairs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(question).alias("q"), F.col(value).alias("v"), F.col(explanation).alias("e"))

    def run(batches):
        for batch in batches:
            q, v, e = (batch.column(i).to_pylist() for i in (1, 2, 3))
            found = pa.array([judge(*x, blank) for x in zip(q, v, e)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["id", "defect"])

    return rows.mapInArrow(run, f"id {kind}, defect string").where("defect is not null").distinct().withColumnRenamed("id", key)
