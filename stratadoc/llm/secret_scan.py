"""Secret scans over an incremental ledger of blobs, in DataFrame expressions only.

Every version of a text is addressed by the SHA-256 of its content. A ledger holds which
(blob, rule version) pairs were scanned, and the findings by blob. scan() takes versions (path,
text), scans each blob once if the ledger hasn't its pair yet, appends to the ledger, and joins
findings back to all paths that hold the blob. So a text that comes back, or that a third of all
paths hold, costs one scan; a new rule version makes every blob unseen again.

A kind is a pattern with a test on the match. Places of matches come from the pieces between them:
splitting a text at a pattern and extracting the pattern's matches give both in order.

A ledger at a path is found again by another session: each scan appends a part to its tables.

Defined results: a null text is an empty one, without findings. Repeated paths give a row each.
Very long texts are scanned whole, as any other. Other columns than path, blob and spans don't pass
through. An empty table gives an empty table. Places are code points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, TableStore, let


@dataclass(frozen=True)
class Kind:
    """pattern: its leftmost non-overlapping matches; holds: a test on a match; hint: what a text with a match contains."""

    name: str
    pattern: str
    holds: Callable[[Column], Column]
    hint: str


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: The kinds of the base; runs shorter than asked for can't hold, so their patterns ask for the length at once.
BASE_KINDS: tuple[Kind, ...] = (
    Kind("assign", _ASSIGN, lambda m: F.length(F.regexp_extract(m, _ASSIGN, 1)) >= 8, r"(?i)passw|secret|token|api_?key"),
    Kind("access", r"AKIA[A-Z0-9]{12,}", lambda m: F.lit(True), "AKIA"),
    Kind("hex", r"[0-9a-f]{32,}", lambda m: F.lit(True), r"[0-9a-f]{32}"),
)
#: What the method adds: tokens with a published prefix, signed web tokens, heads of private keys.
MORE_KINDS: tuple[Kind, ...] = (
    Kind("prefixed", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})", lambda m: F.lit(True), "gh[pousr]_|xox|sk_|AIza"),
    Kind("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", lambda m: F.lit(True), "eyJ"),
    Kind("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", lambda m: F.lit(True), "PRIVATE KEY-----"),
)
KINDS = BASE_KINDS + MORE_KINDS
RULE_VERSION = "1"
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _running(a: Column) -> Column:
    """Running sums of an array of ints: each round adds what stands 1, 2, 4, ... places before."""
    rounds = lambda x: F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(x), F.lit(2)).cast("double"))).cast("int") - 1)
    step = lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0)))
    return let(a, lambda x: F.aggregate(rounds(x), x, step))


def _spans(text: Column, number: int, kind: Kind) -> Column:
    """The matches of one kind that hold, in order."""

    def of(found: Column) -> Column:
        sizes = lambda a: F.transform(a, lambda x: F.length(x))
        both = F.struct(sizes(F.split(text, kind.pattern, -1)).alias("gaps"), sizes(found).alias("own"), found.alias("found"))

        def places(p: Column) -> Column:
            ends = _running(F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["own"])), p["own"], lambda gap, own: gap + own))
            spans = let(ends, lambda e: F.transform(p["found"], lambda m, i: F.struct((F.get(e, i) - F.get(p["own"], i)).alias("start"), F.lit(number).alias("kind"), F.get(e, i).alias("end"), kind.holds(m).alias("holds"))))
            return F.transform(F.filter(spans, lambda s: s["holds"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

        return let(both, places)

    none = F.array().cast(SPAN)
    return F.when(text.rlike(kind.hint), let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda f: F.when(F.size(f) == 0, none).otherwise(of(f)))).otherwise(none)


def find(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """array<struct<start, kind, end>> of all kinds, by start, then kind as listed."""
    return F.sort_array(F.concat(*(_spans(text, i, k) for i, k in enumerate(kinds))))


def joined(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


_SCANNED, _FINDINGS = "blob string, rules string", f"blob string, rules string, spans {SPAN}"


class BlobLedger:
    """scanned (blob, rules) and findings (blob, rules, spans): parts at a path, of which each scan appends its own."""

    def __init__(self, spark: SparkSession, kinds: tuple[Kind, ...] = KINDS, *, rules: str = RULE_VERSION, path: str | None = None) -> None:
        """The ledger at a path, as the last scan left it, or a new one in the shared folder."""
        self.spark, self.kinds, self.rules = spark, kinds, rules
        self.scratch = Scratch(spark, "ledger")
        self.store = TableStore.open(spark, path) if path else TableStore.temporary(spark, "ledger")
        #: Blobs that the last call scanned.
        self.unseen: DataFrame | None = None

    @property
    def scanned(self) -> DataFrame:
        return self.store.read("scanned", _SCANNED)

    @property
    def findings(self) -> DataFrame:
        return self.store.read("findings", _FINDINGS)

    def scan(self, versions: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
        """path, blob, spans of every version; the ledger then knows their blobs."""
        body = F.coalesce(text, F.lit(""))
        addressed = self.scratch.table(versions.select(F.col(path).alias("path"), F.sha2(body, 256).alias("blob")), "addressed")
        blobs = addressed.groupBy("blob").agg(F.min("path").alias("first"))
        if self.store.parts("scanned"):
            blobs = blobs.join(self.scanned.where(F.col("rules") == self.rules).select("blob"), "blob", "left_anti")
        self.unseen = self.scratch.table(blobs, "unseen")
        # one path stands for a blob; a path with several versions has the blob's text once at least
        texts = versions.select(F.col(path).alias("first"), body.alias("body"))
        held = texts.join(self.unseen.select("first").distinct(), texts["first"].eqNullSafe(self.unseen["first"]), "left_semi")
        found = held.select(F.sha2("body", 256).alias("blob"), find(F.col("body"), self.kinds).alias("spans")).where(F.size("spans") > 0)
        found = found.join(self.unseen.select("blob"), "blob", "left_semi").dropDuplicates(["blob"]).select("blob", F.lit(self.rules).alias("rules"), "spans")
        parts = {"findings": [self.store.write(found, "findings")], "scanned": [self.store.write(self.unseen.select("blob", F.lit(self.rules).alias("rules")), "scanned")]}
        self.store = self.store.with_parts(parts)
        mine = self.findings.where(F.col("rules") == self.rules).select(F.col("blob").alias("found_blob"), "spans")
        out = addressed.join(mine, addressed["blob"] == mine["found_blob"], "left")
        return out.select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))

    def compact(self) -> None:
        """One part a table; the parts of earlier versions stay until the folder is cleaned."""
        self.store = self.store.with_parts(replace={name: [self.store.write(df, name)] for name, df in (("scanned", self.scanned), ("findings", self.findings))})
