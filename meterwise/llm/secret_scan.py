"""Secret scans that ask who owns a value: credentials of one owner against copied examples.

Base patterns, leftmost and non-overlapping, each over the whole text:
  assign  a name such as password or api_key (in either case), ``:`` or ``=``, and a value
  access  ``AKIA`` and capitals or digits
  hex     lower-case hexadecimal digits
Shorter matches than ``MIN_LENGTH`` (of the value, for assign) are dropped.

A value alone does not tell a live credential from the example that every tutorial copies; the
corpus does. Every value of a base span, and every other token that may be one (a run of
``TOKEN`` with a letter and a digit, clear of the base spans), is a candidate, known by 128 bits of
its SHA-256. Candidates are counted over the corpus by distinct owners and distinct
repositories (``source`` and the document, unless told otherwise). A token becomes a span of
its own, kind ``token``, if at most ``MAX_OWNERS`` owners have it and it
  * is the value of an assignment anywhere in the corpus (the credential of some base span, quoted
    without its name), or
  * looks live: ``MIN_LIVE`` characters or more, capitals, small letters and digits, and
    ``MIN_DISTINCT`` different characters.
Values with more owners are copied examples: base spans stay (and are counted as examples), tokens
are left alone. No candidate's text leaves its task, only the hash.

Counting is partial before each shuffle: (value, owner, repository) rows are distinct, then summed
by (value, owner) and by value. A value in much of the corpus is one of the few with more rows than a
thousandth of all; these are broadcast to their rows, which therefore do not move.

Edge cases: null and empty texts have no spans; a null owner is an owner of its own (all nulls
together), a null repository likewise; repeated rows give equal rows and count once; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.scratch import written
from meterwise.llm.skew import hot_join

KINDS = ("assign", "access", "hex", "token")
MIN_LENGTH = {"assign": 8, "access": 16, "hex": 32}
MAX_OWNERS = 2
TOKEN = "[A-Za-z0-9_-]"
MIN_TOKEN = 8
MIN_LIVE = 20
MIN_DISTINCT = 12

_NAMES = ("password", "passwd", "secret", "token", "api_?key")
_EITHER_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in _NAMES)
ASSIGN = re.compile(rf"({_EITHER_CASE})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
# whole runs of the class: a shorter run can't be part of a longer one
HEX = re.compile("[0-9a-f]{%d,}" % MIN_LENGTH["hex"])
RUN = re.compile(TOKEN + "{%d,}" % MIN_TOKEN)
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base patterns, by start, then kind; code points."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_LENGTH["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_LENGTH["access"]]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def tokens(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of the runs with a letter and a digit that touch no base span."""
    out, clear, k = [], [], 0
    for s, _, e, _ in base:  # the spans, merged
        if clear and s <= clear[-1][1]:
            clear[-1][1] = max(clear[-1][1], e)
        else:
            clear.append([s, e])
    for m in RUN.finditer(text):
        if not (_DIGIT.search(m[0]) and _LETTER.search(m[0])):
            continue
        while k < len(clear) and clear[k][1] <= m.start():
            k += 1
        if k == len(clear) or clear[k][0] >= m.end():
            out.append((m.start(), m.end(), m[0]))
    return out


def looks_live(value: str) -> bool:
    return (len(value) >= MIN_LIVE and len(set(value)) >= MIN_DISTINCT and any("a" <= c <= "z" for c in value)
            and any("A" <= c <= "Z" for c in value) and any("0" <= c <= "9" for c in value))


def value_hash(value: str) -> bytes:
    """128 bits of a value without the dots and equals signs around it."""
    return hashlib.sha256(value.strip(".=").encode()).digest()[:16]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, owner, repository, row_key, n_assign, n_access, n_hex, base_sha256, base, found) from
    rows (doc_id, owner, repository, text); found: (start, kind, end, hash, live)."""
    found_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.binary()), ("live", pa.bool_())]))
    for batch in batches:
        cols = [[] for _ in range(7)]
        for doc, owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            text = text or ""
            base = base_spans(text)
            spans = _joined([x[:3] for x in base])
            found = [{"start": s, "kind": k, "end": e, "hash": value_hash(v), "live": False} for s, k, e, v in base]
            found += [{"start": s, "kind": 3, "end": e, "hash": value_hash(v), "live": looks_live(v)} for s, e, v in tokens(text, base)]
            key = hashlib.sha256(f"{doc}\0{owner}\0{text}".encode(errors="surrogatepass")).digest()[:16] if found else None
            row = (key, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(spans.encode()).hexdigest(), spans, found)
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), found_type]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                                         names=["doc_id", "owner", "repo", "row_key", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found"])


def ownership(found: DataFrame) -> DataFrame:
    """From rows (hash, owner, repo, assigned): per hash n_owners, n_repos (a repository of two
    owners counts for both), n_rows and whether it was ever assigned."""
    each = found.groupBy("hash", "owner", "repo").agg(F.max("assigned").alias("assigned"), F.count("*").alias("n"))
    owners = each.groupBy("hash", "owner").agg(F.count("*").alias("n_repos"), F.max("assigned").alias("assigned"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n_repos").alias("n_repos"), F.max("assigned").alias("assigned"), F.sum("n").alias("n_rows"))


def scan(docs: DataFrame, *, owner: str = "source", repo: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (base and token spans),
    n_live (spans of values with few owners) and n_examples (base spans of copied values)."""
    kind = lambda c: docs.schema[c].dataType.simpleString()
    rows = docs.select("doc_id", F.col(owner).alias("owner"), F.col(repo).alias("repo"), "text").mapInArrow(
        _scan, f"doc_id {kind('doc_id')}, owner {kind(owner)}, repo {kind(repo)}, row_key binary, n_assign long, n_access long, n_hex long, base_sha256 string, base string, "
        "found array<struct<start: long, kind: int, end: long, hash: binary, live: boolean>>")
    rows = written(rows, "found")
    found = rows.where(F.size("found") > 0).select("row_key", "owner", "repo", F.explode("found").alias("x")).select("row_key", "owner", "repo", "x.*")
    freq = written(ownership(found.withColumn("assigned", F.col("kind") == 0)), "ownership")
    n_found = freq.agg(F.sum("n_rows")).first()[0] or 0
    hot = freq.where(F.col("n_rows") > max(1000, n_found // 1000))  # at most 1,000 values
    few = freq.where(F.col("n_owners") <= max_owners).select("hash", "assigned", F.lit(True).alias("own"))
    told = hot_join(found.select("row_key", "start", "kind", "end", "hash", "live"), few, ["hash"], hot.select("hash"))
    told = told.where((F.col("kind") < 3) | F.col("assigned") | F.col("live"))
    # repeated rows have equal keys and spans: the sets make them count once
    spans = told.groupBy("row_key").agg(F.collect_set(F.struct("start", "kind", "end")).alias("own"))
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform(F.filter("found", lambda x: x["kind"] < 3), lambda x: F.struct(x["start"], x["kind"], x["end"]))
    empty = F.expr("CAST(array() AS array<struct<start: bigint, kind: int, end: bigint>>)")
    own = F.coalesce("own", empty)
    both = F.array_sort(F.array_union(base, own))
    text = F.array_join(F.transform(both, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
    plain = rows.where(F.size("found") == 0).withColumn("spans", F.lit("")).withColumn("n_live", F.lit(0).cast("long")).withColumn("n_examples", F.lit(0).cast("long"))
    held = rows.where(F.size("found") > 0).join(spans, "row_key", "left").withColumn("spans", text).withColumn("n_live", F.size(own).cast("long"))
    held = held.withColumn("n_examples", F.size(F.array_except(base, own)).cast("long"))
    keep = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_examples"]
    return held.select(*keep).unionByName(plain.select(*keep))
