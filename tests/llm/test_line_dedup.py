"""Line dedup against brute force over all pairs of lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from meterwise.llm import line_dedup as L


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs: list[tuple[int, str | None]], key: dict, edits: int) -> dict:
    places: dict[str, list] = {}
    for i, text in docs:
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            line = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line)
            if len(line) >= L.MIN_CHARS:
                places.setdefault(line, []).append((i, key[i, text], pos))
    first = {x: min(p) for x, p in places.items()}
    near = {x for x in first for y in first if x != y and abs(len(x) - len(y)) <= edits and first[y] < first[x] and distance(x, y) <= edits}
    return {p[1:] for x, at in places.items() for p in at if x in near or p != first[x]}


def corpus(seed: int, lines: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd é") for _ in range(rng.randint(18, 50))) for _ in range(12)]
    out = []
    for i in range(lines):
        text = []
        for _ in range(rng.randint(0, 5)):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(s))
                s[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "a", "b"])
            text.append("".join(s))
        out.append((i, "\n".join(text)))
    return [*out, (lines, None), (lines + 1, ""), out[0], (lines + 2, "x" * 30 + "\n" + "x" * 31 + "\n" + "x" * 33)]


@pytest.mark.parametrize(("edits", "hot"), [(1, 64), (1, 2), (2, 64)])
def test_against_brute_force(spark, monkeypatch, edits, hot):
    monkeypatch.setattr(L, "HOT", hot)  # small: most pairs go through the finer segments
    rows = corpus(edits + hot, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {(r.doc_id, r.text): r.k for r in docs.withColumn("k", L._document_key()).collect()}
    want = brute(sorted(set(rows), key=str), keys, edits)
    got = {(r.k, p) for r in L.removals(docs, edits=edits).collect() for p in r.removed}
    assert got == want


def test_within_is_edit_distance(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 7))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        rows = df.select("a", "b", L.within(F.col("a"), F.col("b"), edits).alias("ok"), L.near(F.col("a"), F.col("b"), edits).alias("cut")).collect()
        assert all(r.ok == r.cut == (distance(r.a, r.b) <= edits) for r in rows)


def test_clean_keeps_columns_and_drops_emptied_documents(spark):
    line = "a line that is long enough to count"
    rows = [(1, line + "\nshort", "x"), (2, line, "y"), (3, "", "z"), (4, None, None), (5, line + "s\n  ", "w")]
    out = {r.doc_id: r for r in L.clean(spark.createDataFrame(rows, "doc_id long, text string, removed string")).collect()}
    assert {k: r.text for k, r in out.items()} == {1: line + "\nshort", 3: "", 4: None}
    assert out[1].removed == "x"
    assert L.clean(spark.createDataFrame([], "doc_id long, text string, n_chars long")).collect() == []


def test_short_lines_go_as_exact_repeats_only(spark):
    rows = [(1, "Read more\n\nShare it\nfirst words"), (2, " Read more \nRead mose\n\nsecond words"), (3, "Read more\nShare it"), (4, "a\n\na\n"), (5, "\n \n")]
    out = {r.row.doc_id: r for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.row.text for k, r in out.items()} == {1: rows[0][1], 2: "Read mose\n\nsecond words", 3: "", 4: "a\n\n", 5: "\n \n"}
    assert {k: (r.n_exact, r.n_near, r.whole) for k, r in out.items()} == {1: (0, 0, False), 2: (1, 0, False), 3: (2, 0, True), 4: (1, 0, False), 5: (0, 0, False)}


def test_lines_lose_their_outer_white_space_without_a_regular_expression(spark):
    """A search for the end of a line from every blank in it took a third of the run's time."""
    texts = [" \t\n\x0b\f\r", "a b  c ", "\x0b x\ty \f", " z ", "", "\x00 q", "\x1f w \x1c", " \U0001f600 é\r\n\r"]
    lines = L._lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0)
    want = sorted((i, p, re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x)) for i, t in enumerate(texts) for p, x in enumerate(t.split("\n")))
    assert sorted((r.i, r.pos, r.line) for r in lines.select("i", "pos", "line").collect()) == want
    assert "regexp" not in lines._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("edits", "segments"), [(1, 8), (2, 6)])
def test_refined_keys_are_rows_of_one_expression(spark, edits, segments):
    """An expression per key took the driver's memory: 64 of them where lines are cut into 32 segments."""
    rng = random.Random(edits)
    texts = {"".join(rng.choice("ab") for _ in range(rng.randint(4, 12))) for _ in range(200)}
    lines = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(sorted(texts))], "h long, line string, n int")

    def met(keyed):
        a, b = keyed.where("index").select("key", F.col("h").alias("a")), keyed.select("key", F.col("h").alias("b"))
        return {(r.a, r.b) for r in a.join(b, "key").where("a <> b").distinct().collect()}

    index, probes = L.keys(F.col("line"), F.col("n"), segments, edits)
    each = [F.struct(k.alias("key"), F.lit(j < len(index)).alias("index")) for j, k in enumerate([*index, *probes])]
    plain = lines.select("h", F.explode(F.array(*each)).alias("e")).select("e.key", "e.index", "h")
    rows = L._keyed(lines, segments, edits)
    assert met(rows) == met(plain) != set()
    assert rows.count() == plain.count() and rows.where("index").count() == plain.where("index").count()
    plan = L._keyed(lines, 128, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") == 1 and "from_json" not in plan
