"""Column functions on text: counting, tokenising, normalising, extracting. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates words (everything a Unicode-aware split() takes for white space), as a regex class body.
SPACES = "\\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKENS_PER_WORD = 1.3
TERM = r"[a-z0-9]+(?:[.,][0-9]+)*"  # keeps 1.9, 4,096 and h100 whole
# English function words that say nothing about a passage; a parameter wherever they are used.
STOP_WORDS = (
    "a about above across after again against all almost alone along already also although always am among an and another any are around as at "
    "be because been before being below between both but by can cannot could did do does doing done down during each either else enough even ever every "
    "few for from further had has have having he her here hers him his how however i if in into is it its itself just least less many may me might more most much must my "
    "neither no nor not nothing now of off often on once one only onto or other others our out over own per perhaps rather re same see seem several she should since so some such "
    "than that the their them then there these they this those through thus to together too toward under until up upon us very was we well were what when where whether which while who whom whose why will with within without would yet you your"
).split()


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def approx_tokens(text: Column) -> Column:
    """ceil(1.3 * words), 0 for null."""
    return F.coalesce(F.ceil(F.size(words(text)) * F.lit(TOKENS_PER_WORD)), F.lit(0)).cast("int")


def collapsed(text: Column) -> Column:
    """White space runs as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def terms(text: Column, stop_words=STOP_WORDS) -> Column:
    """Lower-case lexical terms in order, repeated ones kept, stop words left out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"), 1)
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def ngram_terms(text: Column, stop_words=STOP_WORDS) -> Column:
    """Words of two or more letters without stop words, and the pairs of neighbours among them."""
    return with_pairs(plain_words(text, stop_words))


def plain_words(text: Column, stop_words=STOP_WORDS) -> Column:
    """Words of two or more letters in lower case, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1), lambda t: ~t.isin(*stop_words))


def with_pairs(w: Column) -> Column:
    """Words and the pairs of neighbours among them; w is read several times, so it should be a column already made."""
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(w, F.filter(pairs, lambda p: p.isNotNull()))


NUMBERING = r"^(?:[IVXLC]+|[A-Z]|[0-9]+(?:\.[0-9]+)*)\.?\s+"


def section_name(heading: Column) -> Column:
    """A heading without its numbering, blanks and colons at the ends, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(heading, NUMBERING, ""), "^[ :]+|[ :]+$", ""))


HEADING = r"(?=[^\W_])(?:[\W\d_]*[^\W\d_]){3}"  # begins with a letter or digit and holds three letters; matched from the start


def looks_like_heading(text: Column) -> Column:
    return text.rlike("(?U)^" + HEADING)


def stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def table_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table_cell(text: Column) -> Column:
    """A cell's text in one line, its bars escaped."""
    return F.replace(collapsed(F.coalesce(text, F.lit(""))), F.lit("|"), F.lit("\\|"))


def markdown(grid: Column) -> Column:
    """An array of rows of cells as markdown: rows without text left out, the first one as header; empty where none is left."""
    rows = F.filter(F.transform(grid, lambda row: F.transform(row, table_cell)), lambda row: F.exists(row, lambda c: c != ""))
    head = F.slice(rows, 1, 1)
    rule = F.transform(head, lambda row: F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(row))))
    return F.array_join(F.concat(F.transform(head, table_line), rule, F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), table_line)), "\n")


NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"


def numbers_in(text: Column) -> Column:
    """Distinct numbers in text, ascending; commas group digits, a hyphen before a digit is a sign."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({NUMBER})"), 1), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


FIGURE_WORD = r"(?i)\bfig(?:ure)?s?\.?\s*[0-9]+(?:\s*\([0-9A-Za-z_]\))?"


def reply_numbers(reply: Column) -> Column:
    """The numbers of the first line that is not blank, without numbers of figures."""
    lines = F.filter(F.split(F.coalesce(reply, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.trim(F.regexp_replace(x, f"[{SPACES}]", "")) != "")
    return numbers_in(F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), FIGURE_WORD, " "))


def figure_numbers(text: Column) -> Column:
    """Distinct numbers of the figures a text mentions, ascending as text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\bfig(?:ure)?s?\.?\s*([0-9]+)"), 1)))


def has_value(text: Column, value: Column) -> Column:
    return F.exists(numbers_in(text), lambda n: F.abs(n - value) <= F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(value)))


def is_number(text: Column) -> Column:
    """The text is a plain decimal number (with exponent and sign, without grouping)."""
    return text.rlike(r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$")


def answer_number(value: Column, unit: Column) -> Column:
    """The number an answer gives, or null where it has no unit or is none."""
    plain = F.trim(F.replace(value, F.lit(","), F.lit("")))
    given = (F.trim(F.coalesce(unit, F.lit(""))) != "") & (F.trim(unit) != "is_blank")
    return F.when(given & is_number(plain), plain.try_cast("double"))


def answer_type(value: Column) -> Column:
    v = F.trim(value)
    return (
        F.when(v == "is_blank", "unanswerable").when(v.rlike(r"^[(\[]"), "list/range").when(v.isin("0", "1"), "true/false")
        .when(is_number(F.replace(v, F.lit(","), F.lit(""))), "number").otherwise("text")
    )


def ungrouped(value: Column) -> Column:
    """A number with grouped thousands without its commas; anything else as it is."""
    return F.when(value.rlike(r"^-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?$"), F.replace(value, F.lit(","), F.lit(""))).otherwise(value)


def ref_ids(raw: Column) -> Column:
    """The references of a field: a list literal's elements, a single reference, or none for blanks and is_blank."""
    r = F.trim(F.coalesce(raw, F.lit("")))
    listed = F.from_json(r, "array<string>", {"allowSingleQuotes": "true"})
    single = F.when((r == "") | (r == "is_blank"), F.array().cast("array<string>")).otherwise(F.array(r))
    return F.when(r.startswith("["), F.coalesce(listed, single)).otherwise(single)


def _segments(parts: Column, least: int) -> Column:
    split = F.flatten(F.transform(parts, lambda p: F.split(p, r"\.\.\.|…|\s--\s")))
    bare = F.transform(split, lambda p: F.regexp_replace(p, r"^[ .…'\"]+|[ .…'\"]+$", ""))
    return F.filter(bare, lambda p: F.size(words(p)) >= least)


def evidence(supporting: Column, least: int = 6) -> Column:
    """Verbatim segments of at least `least` words: quoted spans, or else the text cut at `refid:` markers; elisions cut both."""
    s = F.coalesce(supporting, F.lit(""))
    quoted = _segments(F.regexp_extract_all(s, F.lit(r"[\"“]([^\"”]+)[\"”]"), 1), least)
    marked = _segments(F.split(F.regexp_replace(s, r"(?i)^\s*(?:quote|evidence)\s*:\s*", ""), r"\b[a-z]+[0-9]{4}[a-z]?\s*:\s*"), least)
    return F.when(F.size(quoted) > 0, quoted).otherwise(marked)


def embed_hash(model: Column, text: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\n"), text), 256)


def collection_name(strategy: Column, model: Column) -> Column:
    return F.regexp_replace(F.concat(strategy, F.lit("__"), model), r"[^A-Za-z0-9._-]", "-")


def instructed(query: Column, instruction: str | None) -> Column:
    return query if not instruction else F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), query)


def table_label(text: Column) -> Column:
    """The number a table's text starts with (`Table IV`), upper case, or empty."""
    return F.upper(F.regexp_extract(F.substring(text, 1, 80), r"(?i)^\W*table\s+([ivxlc]+|[0-9]+)\b", 1))


def table_mentions(text: Column) -> Column:
    """The numbers of the tables a text mentions, upper case, in order, repeated ones kept."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b(?:table|tab\.)\s+([ivxlc]+|[0-9]+)\b"), 1), F.upper)


def without_thinking(reply: Column) -> Column:
    return F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")


def json_object(reply: Column) -> Column:
    """The text of the JSON object in a reply, code fences and chatter around it left out; null where there is none."""
    bare = F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*|\s*```$", "")
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


ARXIV = r"arxiv\.org/(?:abs|pdf)/"


def preprint(url: Column, host: str = ARXIV, name: str = r"[a-zA-Z.\-]*/?[0-9]{4,7}(?:\.[0-9]+)?") -> tuple[Column, Column]:
    """(id, version): what a preprint URL names, the version (`v2`) empty where it names none."""
    return F.regexp_extract(url, f"{host}({name})", 1), F.regexp_extract(url, f"{host}{name}(v[0-9]+)", 1)


def version_check(pinned: Column, stamped: Column) -> Column:
    """match, mismatch vN, no-stamp or unpinned: the version a URL names against the one printed in the text."""
    return F.when(pinned == "", "unpinned").when(stamped == "", "no-stamp").when(pinned == stamped, "match").otherwise(F.concat(F.lit("mismatch "), stamped))
