"""Secret scan by corpus-wide ownership of candidates.

Tasks find candidates in every text: values assigned to a telling name, access key ids, long
hexadecimal runs, and bare runs of letters and digits that look random. A candidate goes on as a
hash, never as a value. The hashes are counted over the whole corpus: by distinct
repositories and by distinct owners. What several owners have is an example that is copied around
(documentation, fixtures, licence texts); what looks random and belongs to few owners is taken for
a live credential of theirs. Bare runs judged live are added to the spans; the spans of the
first three kinds stay, whatever their verdict.

Counting begins with distinct (hash, owner, repository), combined before it is shuffled, then
counts by (hash, owner), then by hash: a value that a third of all rows hold is a few rows at
each step. Only rows with candidates are joined with the verdicts, and only live ones come back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berrak.llm.tables import packed_schema, written

#: Fixed values of the task: names, kinds in their order, and patterns.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
KINDS = ("assign", "access", "hex", "owned")


def either_case(pattern: str) -> str:
    """ASCII letters in either case; no other letter that a folding engine would add."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


ASSIGN = f"({either_case('|'.join(NAMES))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# the runs are maximal, so that asking for the length at once finds the same ones
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
LEAST_VALUE = 6


@dataclass(frozen=True)
class Ownership:
    """A candidate of over ``most_owners`` owners is a copied example.

    One looks random from ``least_digits`` digits, ``least_letters`` ASCII letters and ``least_distinct``
    different characters on; a bare run has ``least_run`` characters besides.
    """

    most_owners: int = 2
    least_run: int = 20
    least_digits: int = 3
    least_letters: int = 3
    least_distinct: int = 10


def looks_random(value: str, how: Ownership) -> bool:
    digits = sum("0" <= c <= "9" for c in value)
    letters = sum("a" <= c <= "z" or "A" <= c <= "Z" for c in value)
    return digits >= how.least_digits and letters >= how.least_letters and len(set(value)) >= how.least_distinct


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """kind, start, end and value of the matches of the three kinds, by start, then kind."""
    found = [("assign", m.start(), m.end(), m[2]) for m in _assign.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [("access", m.start(), m.end(), m[0]) for m in _access.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in _hex.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_assign, _access, _hex = (re.compile(p) for p in (ASSIGN, ACCESS, HEX))


def bare_runs(text: str, spans: list[tuple[str, int, int, str]], how: Ownership) -> list[tuple[str, int, int, str]]:
    """Random-looking runs that no span touches."""
    out, k = [], 0
    ends: list[tuple[int, int]] = []
    for _, start, end, _ in spans:
        if ends and start < ends[-1][1]:
            ends[-1] = (ends[-1][0], max(end, ends[-1][1]))
        else:
            ends.append((start, end))
    for m in re.finditer(f"[A-Za-z0-9]{{{how.least_run},}}", text):
        while k < len(ends) and ends[k][1] <= m.start():
            k += 1
        if (k == len(ends) or ends[k][0] >= m.end()) and looks_random(m[0], how):
            out.append(("owned", m.start(), m.end(), m[0]))
    return out


def _digest(value: str) -> bytes:
    return hashlib.blake2b(value.encode(), digest_size=16).digest()


CANDIDATE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.binary()), ("random", pa.bool_())])
FOUND = "candidates array<struct<kind: string, start: long, end: long, hash: binary, random: boolean>>"


def _scan(batches: Iterator[pa.RecordBatch], how: Ownership) -> Iterator[pa.RecordBatch]:
    """The candidates of every row. A linear pattern tells which texts can have any."""
    any_of = f"{either_case('|'.join(NAMES))}[\"']? *[:=]|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}|[A-Za-z0-9]{{{how.least_run}}}"
    for batch in batches:
        texts = batch.column("text")
        may = pc.fill_null(pc.match_substring_regex(texts, any_of), False)
        rows = []
        for value, look in zip(texts, may.to_pylist(), strict=True):
            text = value.as_py() if look else ""
            spans = base_spans(text)
            spans += bare_runs(text, spans, how)
            rows.append([{"kind": kind, "start": a, "end": b, "hash": _digest(v), "random": looks_random(v, how)} for kind, a, b, v in spans])
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("owner"), batch.column("repository"), pa.array(rows, pa.list_(CANDIDATE))], names=["doc", "owner", "repository", "candidates"])


def candidates(docs: DataFrame, text: str, owner: str, repository: str, keep: list[str], how: Ownership) -> DataFrame:
    """doc (the columns ``keep``), owner, repository and candidates of every row, written, numbered by ``row``."""
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{text}`").alias("text"), name(owner).alias("owner"), name(repository).alias("repository"))
    found = packed.mapInArrow(lambda x: _scan(x, how), packed_schema(packed, f"owner string, repository string, {FOUND}"))
    return written(found.withColumn("row", F.monotonically_increasing_id()), "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories of every candidate of ``found``."""
    each = found.where(F.size("candidates") > 0).select("owner", "repository", F.explode(F.array_distinct(F.transform("candidates", lambda c: c["hash"]))).alias("hash")).distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def _joined(spans):
    """kind:start:end by start, then kind as listed."""
    order = F.array(*map(F.lit, KINDS))
    keyed = F.array_sort(F.transform(spans, lambda c: F.struct(c["start"].alias("start"), F.array_position(order, c["kind"]).alias("k"), c["end"].alias("end"), c["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")


OUT = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_owned", "n_live", "n_copied")


def scan(docs: DataFrame, owner: str, repository: str, text: str = "text", keep: list[str] | None = None, how: Ownership = Ownership()) -> DataFrame:
    """The columns ``keep`` (all by default) of every row, then those of ``OUT``; columns of these names are replaced.

    A repository is known by its owner and its name. ``spans`` are those of the base kinds and the added
    ``owned`` ones (places in code points, ends exclusive); ``base_sha256`` is the digest of the base spans alone.
    ``n_owned`` counts what was added, ``n_live`` all candidates that look random and have at most
    ``most_owners`` owners, ``n_copied`` those with more.

    Null and empty texts have no spans; null owners and repositories count as empty strings; repeated
    rows keep their rows and count once; an empty table stays empty.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in OUT]
    found = candidates(docs, text, owner, repository, keep, how)
    has = F.size("candidates") > 0
    each = found.where(has).select("row", F.explode("candidates").alias("c"))
    judged = each.join(ownership(found).select(F.col("hash").alias("known"), "n_owners"), F.col("c.hash") == F.col("known"))
    copied = F.col("n_owners") > how.most_owners
    live = ~copied & F.col("c.random")
    by_row = judged.groupBy("row").agg(
        F.count_if(live).alias("n_live"), F.count_if(copied).alias("n_copied"),
        F.collect_list(F.when(live & (F.col("c.kind") == "owned"), F.struct("c.kind", "c.start", "c.end"))).alias("added"),
    )
    narrow = F.transform("candidates", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    nothing = {"n_live": F.lit(0).cast("long"), "n_copied": F.lit(0).cast("long"), "added": F.array().cast("array<struct<kind: string, start: long, end: long>>")}
    rows = found.withColumn("base", F.filter(narrow, lambda c: c["kind"] != "owned"))
    told = rows.where(has).join(by_row, "row").unionByName(rows.where(~has).withColumns(nothing))
    count = lambda kind: F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long")
    return told.select(
        *[F.col(f"doc.`{c}`").alias(c) for c in keep],
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_owned"),
        "n_live",
        "n_copied",
    )
