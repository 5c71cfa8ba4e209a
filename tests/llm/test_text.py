"""Confusables, broken pairs, splitting and shared spans."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserine.llm import confusables as c
from tesserine.llm import pairs, spans, splitting


@pytest.mark.parametrize(("a", "b"), [("Ｆｉｇ．１", "Fig.1"), ("Весаusе", "Because"), ("é", "é"), ("a​b﻿", "ab"), ("a b c", "a b c"), ("ﬁnd oﬀ", "find off"), ("ÅK", "ÅK"), ("loϲal", "local"), ("Ｃｏ̂te", "Côte"), ("한", "한"), ("non‑stop", "non-stop"), ("µm", "μm"), ("Ⅳ ⅼ", "IV l"), ("ӀI", "II"), ("ᴄᴏꜱ", "cos"), ("⼀", "一"), ("rockʼn", "rock’n")])
def test_look_alike(a, b):
    assert c.skeleton(a) == c.skeleton(b)
    assert c.consistent(a) == c.consistent(b)


@pytest.mark.parametrize(("a", "b"), [("10²", "102"), ("CO₂", "CO2"), ("Cote", "Côte"), ("a", "A"), ("l", "I"), ("0", "O"), ("a b", "a  b"), ("×", "x"), ("1", "l"), ("½", "1/2"), ("…", "..."), ("a\nb", "a b"), ("η", "n"), ("–", "-")])
def test_visibly_different(a, b):
    assert c.skeleton(a) != c.skeleton(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_skeleton_is_stable(text):
    assert c.skeleton(c.skeleton(text)) == c.skeleton(text) and c.skeleton(c.consistent(text)) == c.skeleton(text)


def test_look_alike_pairs(spark):
    rows = [("k1", "d", "Fig", ["a", None]), ("k2", "d", "Ｆig", ["а", None]), ("k2", "d", "Ｆig", ["а", None]), ("k3", "e", "Fig", ["a"]), ("k4", "e", None, None), ("k5", "e", "", []), ("k6", "e", "fig", ["a", ""]), (None, "e", "Ｆig", ["а"]), ("k7", "d", "x" * 100_000, None)]
    df = spark.createDataFrame(rows, "key string, doc string, text string, path array<string>").withColumn("raw", F.lit(1)).withColumn("form", F.lit(2))
    assert {tuple(r) for r in c.look_alikes(c.forms(df, "key", "text")).collect()} == {("k1", "k2"), ("k2", "k3")}
    assert {tuple(r) for r in c.look_alikes(c.forms(df, "key", "path", "doc")).collect()} == {("k1", "k2")}
    out = {r.key: r for r in c.unified(df, "text", "path").collect()}
    assert out["k2"].text == "Fig" and out["k2"].path == ["a", None] and out["k4"].text is None and out["k5"].path == [] and out["k2"].raw == 1
    assert c.look_alikes(c.forms(df.limit(0), "key", "text")).count() == 0
    more = df.unionByName(df.where("key = 'k1'").withColumn("key", F.lit("k9")))  # a copy of a value is no link, but has its links
    assert {tuple(r) for r in c.look_alike_classes(c.forms(more, "key", "text")).collect()} == {("k1", "k1", 1), ("k2", "k1", 3), ("k3", "k1", 1), ("k9", "k1", 1)}
    assert c.look_alike_classes(c.forms(df.limit(0), "key", "text")).count() == 0
    with pytest.raises(ValueError):
        c.unified(df, "none")


Q = "Which total energy do the authors report for the upstream vector shard that serves the job?"
SOUND = "The operational line supports the rural pool behind a local well, so the total is 5 kWh. It is printed in the table."
CASES = [
    ("5", SOUND, None), ("is_blank", "None of the passages states a figure for the specific record in Drovany.", None), ("n/a", SOUND, "empty"), ("5", "​", "empty"), ("5", None, "empty"), (None, SOUND, "empty"), ("''", SOUND, "empty"), ("...", SOUND, "empty"),
    ("5", "Value read from Table 13", None), ("5", "See Figure 3 of the appendix", None), ("6", "See Figure 14 of the appendix", None), ("5", "The operational line supports the rural pool behind a local well, so the total is", "truncated"), ("5", SOUND + " The rural and the", "truncated"),
    ("5", "It needs 12.5 ×", "truncated"), ("The line supports the pool behind a well and the", SOUND, "truncated"), ("I must decline to answer", SOUND, "refusal"), ("is_blank", "Sorry, I am unable to answer questions about the shard.", "refusal"),
    ("5", "Leider darf ich zur Spitze keine Auskunft geben.", "refusal"), ("5", "Désolé, mais je ne peux pas répondre à cette demande.", "refusal"), ("5", "Lo siento, pero no estoy autorizado a hablar de la comuna.", "refusal"),
    ("5", "The authors say they are sorry to have omitted the load, yet the table gives it. The operator cannot cool the hall with the line, so it sets the value.", None), ("5", Q.upper(), "copy"), ("Question: " + Q, SOUND, "copy"), ("5", Q + " " + Q, "copy"),
    ("5", Q + " " + SOUND, None), ("5", "Die alte Planung ersetzt die offene Rechnung durch die neue Batterie und danach die tiefe Quelle bei Dalvix.", "language"), ("5", "根据公布的资料，该机房的能耗为463.61，计算过程见正文。", "language"),
    ("Fen Yard", SOUND, None), ('["Alder & Sons, Inc.", "Dune, Marsh and Co."]', SOUND, None), ("7.6 × 10^4 megajoules", SOUND, None), ("5", SOUND + " " + "word " * 30_000 + "end.", None),
]


def test_broken_pairs(spark):
    rows = [(i, Q, v, e, "x") for i, (v, e, _) in enumerate(CASES)]
    df = spark.createDataFrame([*rows, rows[2], (None, Q, "n/a", SOUND, "x"), (500, None, "5", SOUND, "x")], "gen_id long, question string, answer_value string, explanation string, defect string")
    got = [(r.gen_id, r.defect) for r in pairs.broken_pairs(df).collect()]
    assert sorted(got) == [(i, d) for i, (_, _, d) in enumerate(CASES) if d]
    assert pairs.broken_pairs(df.limit(0)).count() == 0


def test_cut_off_word_in_a_note(spark):
    df = spark.createDataFrame([(1, Q, "5", "Read off the shard"), (2, Q, "5", "Read off the sha"), (3, Q, "5", SOUND)], "gen_id long, question string, answer_value string, explanation string")
    assert [tuple(r) for r in pairs.broken_pairs(df).collect()] == [(2, "truncated")]


CUT = ["Table 19 lists the est", "Does the evaporative waste heat ne", "Between 2019 and 2021 the audi", "Between 2020 and 2024 the audi", "See Figure 3 of the append", "In Havolen, each local latency target roug", "We compare a sparse re"]
NOTES = ["See Figure 3 of the appendix", "See Figure 14 of the appendix", "Sum of both rows in Table 5", "Value read from the table", "Read off the shard", "The sum of both rows", "Converted to MWh"]


def test_notes_are_judged_by_their_own_row(spark):
    texts = CUT + NOTES + ["Il est un ne re sc audi append sparse word, audi est ne re append roug here."]  # fragments that are words in another row
    rows = [(i, Q, "5", e) for i, e in enumerate(texts + texts)]
    df = spark.createDataFrame(rows, "gen_id long, question string, answer_value string, explanation string")
    got = {tuple(r) for r in pairs.broken_pairs(df).collect()}
    assert {i % len(texts) for i, d in got if d == "truncated"} == set(range(len(CUT)))
    for i, text in enumerate(CUT + NOTES):
        assert pairs.broken_pairs(df.where(F.col("gen_id") == i)).count() == (i < len(CUT)), text


@pytest.mark.parametrize(
    ("text", "refuses"),
    [
        (SOUND + " " + Q + " " + SOUND + " I am unable to answer this.", True), (SOUND * 40 + " Leider darf ich zur Spitze keine Auskunft geben.", True), (SOUND * 3 + " As an AI, discussing the shard is out of scope.", True),
        (SOUND * 3 + " It is said here that, as a language model, I stay silent.", True), (SOUND * 3 + " The hall is used as an AI training site and cannot be cooled by the line.", False), ("The hall serves as an AI training site.", False),
        (SOUND * 400, False),
    ],
)
def test_refusal_after_a_long_preamble(text, refuses):
    assert (pairs.judge(Q, "5", text, "is_blank") == "refusal") == refuses


@pytest.mark.parametrize("text", ["I'm afraid I can not help with that request.", "I will refrain from answering this question.", "Mi dispiace, non posso rispondere a questa domanda.", "word " * 35 + "I cannot provide the figure.", "Não posso responder a essa pergunta."])
def test_refusals_in_other_words(text):
    assert pairs.judge(Q, "5", text, "is_blank") == "refusal"


@pytest.mark.parametrize(("text", "defect"), [("La respuesta es correcta.", "language"), ("Der Wert ist in der Tabelle.", "language"), ("La valeur est dans le tableau.", "language"), ("See Table 4.", None), ("The value is in the table.", None), ("In Côtebrune, see the table.", None)])
def test_language_of_short_responses(text, defect):
    assert pairs.judge(Q, "5", text, "is_blank") == defect


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert pairs.common_subsequence(a, b) == table[-1][-1]


def items(spark, rows):
    return spark.createDataFrame(rows, "item string, kind string, text string, heading_path array<string>, item_key int, piece_no int")


def test_pieces(spark):
    rng = random.Random(7)
    texts = {
        "a": ("text", " ".join("w" * rng.randint(1, 9) + rng.choice(["", "", ".", ",", ".\n\n"]) for _ in range(3000))), "b": ("table", "Title\n\n" + "\n".join(f"| {i} | x y |" for i in range(300))),
        "c": ("code", "\n".join("    " * (i % 3 > 0) + f"x{i} = load('a b', {i})" for i in range(250))), "d": ("text", "x" * 200_000), "e": ("text", "word " * 307), "f": ("text", "word " * 308), "g": ("text", None), "h": ("text", ""),
        "i": ("text", "a b. " * 200 + "\nThe Heading\n" + "c d. " * 200), "j": (None, "y z " * 2000),
    }
    rows = [(k, kind, t, ["The Heading"], 1, 2) for k, (kind, t) in texts.items()]
    got: dict = {}
    for r in splitting.split_oversized(items(spark, rows + rows[:2] + [(None, "text", "w " * 999, None, 1, 1)]), "item").orderBy("item_key", "piece_no").collect():
        got.setdefault(r.item_key, []).append(r)
    assert sorted(got) == [k for k, (_, t) in sorted(texts.items()) if t and splitting.tokens(len(t.split())) > 400]
    for k, pieces in got.items():
        text = texts[k][1]
        assert [p.piece_no for p in pieces] == list(range(len(pieces)))
        assert all(p.tokens <= 400 and p.tokens == splitting.tokens(len(p.text.split())) and p.text == text[p.start_char : p.end_char] for p in pieces)
        assert sum((text[p.new_char : p.end_char].split() for p in pieces), []) == text.split()  # every word once
        for one, two in zip(pieces, pieces[1:]):
            assert splitting.tokens(len(text[two.start_char : one.end_char].split())) == 50
    assert all("\n" in texts["b"][1][p.end_char : p.end_char + 1] for p in got["b"][:-1])  # rows stay whole
    assert any(texts["i"][1][p.new_char :].startswith("The Heading") for p in got["i"])
    assert splitting.split_oversized(items(spark, []), "item").count() == 0


def test_doubling_matches_one_by_one():
    import numpy as np

    rng = np.random.default_rng(8)
    tables = []
    for n in (1, 2, 7, 100, 1000):
        s = np.minimum(np.arange(n + 1) + rng.integers(1, 9, n + 1), n)
        tables.append(s)
    for s, cut in zip(tables, splitting.cuts(tables)):
        want = [0]
        while want[-1] < len(s) - 1:
            want.append(int(s[want[-1]]))
        assert cut.tolist() == want


def brute_shares(docs, least):
    where: dict = {}
    for i, t in docs:
        for p in range(len(t) - least + 1):
            where.setdefault(t[p : p + least], set()).add(i)
    out = {}
    for i, t in docs:
        shared, later = bytearray(len(t)), bytearray(len(t))
        for p in range(len(t) - least + 1):
            ids = where[t[p : p + least]]
            if len(ids) > 1:
                shared[p : p + least] = b"\1" * least
                if min(ids) != i:
                    later[p : p + least] = b"\1" * least
        out[i] = (sum(shared), sum(shared) - sum(later))
    return out


def test_hot_spans_match_brute_force(spark):
    """A group that holds most records, whose members leave each other at many places, and runs that repeat within a record."""
    rng = random.Random(10)
    noise = lambda n: "".join(rng.choices("abcdefghij .", k=n))
    stem, docs = noise(900), []
    for i in range(70):
        a, b = sorted(rng.sample(range(900), 2))
        middle = stem[a:b] if rng.random() < 0.8 else stem[a:b] + noise(rng.randint(0, 9)) + stem[a:b]
        docs.append((i, noise(rng.choice([0, 0, 5, 300])) + "xy"[: rng.randint(0, 2)] + middle + "uv"[: rng.randint(0, 2)] + noise(rng.choice([0, 0, 5, 300]))))
    docs += [(100 + i, docs[i][1]) for i in range(8)]
    one, two = noise(210), noise(230)
    docs += [(200, one + noise(150) + two), (201, one + noise(150) + two)]  # two spans at the same distance
    want = brute_shares(docs, 200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.shared_chars, r.first_chars) for r in spans.shared_spans(df, "doc_id", "text").collect()}
    assert got == want and sum(s > 0 for s, _ in want.values()) > 40
    kept = {r.doc_id: r for r in spans.without_repeats(df, "doc_id", "text").collect()}
    assert all(kept[100 + i].text == "" or want[100 + i][0] == 0 for i in range(8)) and all(k.removed <= k.sentences for k in kept.values())


def test_runs_of_sentences():
    import numpy as np

    rng = random.Random(11)
    text = "".join(rng.choices("abc. ", k=5000))
    parts = [text, "short", "q" * 700, ("z" * 150 + ". ") * 30]
    number, start, h = spans.sentence_runs(parts, 200)
    for i in (0, 3):
        own = start[number == i]
        for p in range(len(parts[i]) - 199):  # every span of 200 characters holds a whole run
            assert ((own >= p) & (own + spans.RUN <= p + 200)).any()
    assert 1 not in number
    old, spans.SEGMENT = spans.SEGMENT, 700
    try:
        assert all(np.array_equal(a, b) for a, b in zip(spans.sentence_runs(parts, 200), (number, start, h)))
    finally:
        spans.SEGMENT = old
    for _ in range(300):
        a, b = "".join(rng.choices("ab", k=rng.randint(0, 90))), "".join(rng.choices("ab", k=rng.randint(0, 90)))
        a, b = (a + "x" * 200, b + "x" * 199 + "y") if rng.random() < 0.5 else (a, b)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        n = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
        m = next((k for k in range(min(i, j)) if a[i - 1 - k] != b[j - 1 - k]), min(i, j))
        assert spans.common_after(a, b, i, j) == n and spans.common_before(a, b, i, j) == m


def test_shared_spans_match_brute_force(spark):
    rng = random.Random(9)
    sentence = lambda: " ".join("".join(rng.choices("abcdefgé", k=rng.randint(1, 9))) for _ in range(rng.randint(2, 25))) + rng.choice([". ", "! ", "\n", " "])
    docs = [(i, "".join(sentence() for _ in range(rng.randint(0, 8)))) for i in range(60)]
    for n in (199, 200, 201, 350):
        for _ in range(5):
            span = "".join(rng.choices("abc defg", k=n))
            for _ in range(rng.randint(2, 4)):
                i = rng.randrange(60)
                at = rng.randint(0, len(docs[i][1]))
                docs[i] = (i, docs[i][1][:at] + span + docs[i][1][at:])
    docs += [(100, "z" * 5000), (101, "z" * 300), (102, docs[0][1]), (103, ""), (104, "q" * 700)]
    want = brute_shares(docs, 200)
    rows = [(i, t, 1) for i, t in docs] + [(docs[3][0], docs[3][1], 1), (200, None, 1), (None, "z" * 900, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").withColumn("h", F.lit(1))
    got = {r.doc_id: r for r in spans.shared_spans(df, "doc_id", "text").collect()}
    assert set(got) == set(want) | {200} and got[200].n_chars == 0 and got[200].share == 0
    assert {i: (got[i].shared_chars, got[i].first_chars) for i in want} == want
    assert sum(s > 0 for s, _ in want.values()) > 20 and want[104] == (0, 0) and want[101][0] == 300
    assert spans.shared_spans(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        spans.shared_spans(df, "doc_id", "text", 100)
