"""MinHash near-dedup by an inverted join of signature coordinates.

A document is the set of its distinct word shingles (A-Z lower-cased, ASCII white space between
words). A word is hashed to 64 bits by XXH3 with a ``seed``, a shingle to 64 bits of its words'
hashes; sets are compared by these hashes, where two different shingles are taken for one with a
probability of 2**-64. Who must fear texts that are made to collide keeps the seed to themselves.
Equal sets are one class. A class has a signature of N_COORDS minima; each (coordinate,
value) pair is a token with a posting list.

Two classes whose signatures agree in MATCHES coordinates or more are candidates. Tokens are
ordered by the length of their lists: the MATCHES - 1 longest lists of a class are skipped, since
candidates must meet in one of the others (its prefix); lists of one are no lists. Shingles that no
other listed class has are counted: two classes can share no more than the rest of either, which
rules out classes and pairs for good. Inside a list each class is paired with a pivot. Collisions of
a pair are counted over all coordinates, pairs below MATCHES go, the others are confirmed on full
shingle sets. Components follow; lists whose classes aren't all in one component yet get a second
pivot. At last the classes that stay outside their lists' largest component are met in blocks with
all classes of these lists, on full sets; a block gives its links alone. A group of more blocks than
a class has shingles in its prefix is dealt by shingles first: two similar sets share one of their
rarest shingles (PREFIX of the set's size), so only classes that do are met. So no pair that could
join two components goes unseen, and a list of many copies costs as many rows as it has classes.

At N_COORDS = 48 and MATCHES = 22 a pair of similarity 0.8 is missed as a candidate with a
probability of about 3 in 10**8, of 0.85 of 5 in 10**11.

Defined results: a text of fewer words than a shingle is one shingle, of no words (or null) an
empty set, linked with nothing. Rows without doc_id take part in nothing: component null, kept
true. Repeated rows and rows that share a doc_id are judged by their own texts; components() says
kept of all rows with the component's doc_id, dedup() keeps one row of a component: of its first
doc_id, and of rows that share that, one with the first class. Very long texts are hashed in pieces
that end at white space. Columns pass through; n_shingles, component_id and kept replace columns of
these names. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, Scratch, byte_sizes, slices, tidy
from .components import connected_components

N_COORDS, MATCHES = 48, 22
#: Text and documents that are shingled at once; the arrays of a slice take about fifty times its text.
SLICE_BYTES, SLICE_ROWS = 1_000_000, 16_384
#: Bits of the map of documents whose sets are needed, at most; more documents than an eighth of them pass it more and more by chance, and are told apart behind it.
MAP_BITS = 1 << 26
#: Classes and shingles of a block in which links are sought that pivots haven't found, about.
BLOCK_ROWS, BLOCK_SHINGLES = 400, 1_000_000
_SPACE = re.compile(b"[" + re.escape(ASCII_SPACE) + b"]")
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multipliers(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _P + np.uint64(seed)) | np.uint64(1)


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """A text in pieces of about size bytes that end at white space, so that its words are never a list at once."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + size) if at + size < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


class Shingler:
    """Sets of shingles of a batch of texts, in arrays."""

    def __init__(self, size: int, seed: int) -> None:
        self.size, self.seed = size, seed
        self.turn = _multipliers(size + 1, 11)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(self.seed)), np.uint64, len(words))

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and hashes of the distinct shingles of at most SLICE_ROWS whole texts, ordered by both."""
        n, size, turn = len(texts), self.size, self.turn
        held = [x.lower() if x else b"" for x in texts.cast(pa.large_binary()).to_pylist()]
        if sum(map(len, held)) <= 2 * SLICE_BYTES:
            split = [x.split() for x in held]
            per_doc = np.fromiter(map(len, split), np.int64, n)
            words = self._hashes([w for ws in split for w in ws])
        else:
            parts = [[self._hashes(piece.split()) for piece in _pieces(x, SLICE_BYTES)] for x in held]
            per_doc = np.array([sum(map(len, p)) for p in parts], np.int64)
            words = np.concatenate([np.zeros(0, np.uint64), *(a for p in parts for a in p)])
        owner = np.repeat(np.arange(n, dtype=np.int64), per_doc)
        k = max(len(words) - size + 1, 0)
        whole = np.zeros(k, np.uint64)
        for j in range(size):
            whole += words[j : j + k] * turn[j]
        inside = owner[:k] == owner[size - 1 : size - 1 + k]
        hashes, docs = _mix(whole[inside]), owner[:k][inside]
        few = np.flatnonzero((per_doc > 0) & (per_doc < size))
        if len(few):
            at = np.r_[0, np.cumsum(per_doc)]
            short = [sum(((int(words[at[d] + j]) * int(turn[j])) for j in range(per_doc[d])), int(per_doc[d]) * int(turn[size])) % (1 << 64) for d in few.tolist()]
            hashes, docs = np.r_[hashes, _mix(np.array(short, np.uint64))], np.r_[docs, few]
        order = np.argsort(hashes)
        order = order[np.argsort(docs[order].astype(np.uint16), kind="stable")]
        hashes, docs = hashes[order], docs[order]
        if len(hashes):
            first = np.r_[True, (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])]
            hashes, docs = hashes[first], docs[first]
        return docs, hashes


def _segments(docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the n documents' sets; the documents that have one, and where theirs start."""
    sizes = np.bincount(docs, minlength=n)
    full = np.flatnonzero(sizes)
    return sizes, full, np.r_[0, np.cumsum(sizes)[:-1]][full].astype(np.int64)


def _classes(hashes: np.ndarray, full: np.ndarray, starts: np.ndarray, n: int) -> list[pa.Array]:
    """128 bits that name a set, by document."""
    out = np.zeros((n, 2), np.int64)
    if len(full):
        spread = _mix(hashes + np.uint64(1))
        out[full, 0] = np.add.reduceat(spread, starts).view(np.int64)
        out[full, 1] = np.add.reduceat(_mix(spread + _P), starts).view(np.int64)
    return [pa.array(out[:, 0]), pa.array(out[:, 1])]


_KEY = ["class_hi", "class_lo", "n_shingles"]


def _signatures(size: int, seed: int, n_coords: int, in_row: bool):
    """The columns of a batch (doc_id, text, or one struct row that has them) with the class and signature of each text."""
    turn, shift = _multipliers(n_coords, 29), _multipliers(n_coords, 31)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size, seed)
        for whole in batches:
            row = whole.column("row") if in_row else whole
            every = row.field("text") if in_row else row.column("text")
            ids = row.field("doc_id") if in_row else row.column("doc_id")
            for start, n in slices(byte_sizes(every), SLICE_BYTES, SLICE_ROWS):
                docs, hashes = shingler.sets(every.slice(start, n))
                sizes, full, starts = _segments(docs, n)
                signature = np.zeros((n, n_coords), np.uint32)
                for c in range(n_coords if len(full) else 0):
                    signature[full, c] = np.minimum.reduceat(((hashes * turn[c] + shift[c]) >> np.uint64(32)).astype(np.uint32), starts)
                at = np.r_[0, np.cumsum(np.where(sizes > 0, n_coords, 0))].astype(np.int32)
                flat = signature[full].view(np.int32).ravel()
                held = [ids.slice(start, n).cast(pa.int64()), *_classes(hashes, full, starts, n), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
                names = ["doc_id", *_KEY, "signature"]
                yield pa.RecordBatch.from_arrays([*held, row.slice(start, n)] if in_row else held, [*names, "row"] if in_row else names)

    return tidy(run)


_SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(k, T.LongType()) for k in _KEY), T.StructField("signature", T.ArrayType(T.IntegerType()))])


def _sets(size: int, seed: int, wanted: np.ndarray):
    """The sets of the texts whose place (at) is marked in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size, seed)
        for whole in batches:
            at = whole.column("at").to_numpy()
            whole = whole.filter(pa.array(wanted[at >> 3] >> (at & 7) & 1 == 1))
            every = whole.column("text")
            for start, n in slices(byte_sizes(every), SLICE_BYTES, SLICE_ROWS):
                docs, hashes = shingler.sets(every.slice(start, n))
                sizes, full, starts = _segments(docs, n)
                at = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*_classes(hashes, full, starts, n), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(hashes.view(np.int64)))], [*_KEY, "shingles"])

    return tidy(run)


def _marked(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of bits / 8 bytes with the places of the doc_ids of ids."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    rows = ids.select(F.floor(place / _BUCKET).cast("int").alias("b"), (place % _BUCKET).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("map")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for b, held in rows:
        out[b * _BUCKET // 8 : (b + 1) * _BUCKET // 8] = np.frombuffer(held, np.uint8)[: _BUCKET // 8]
    return out


#: Bits of one of Spark's bitmaps.
_BUCKET = 1 << 15


def _links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        empty = pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
        if not asks.any() or asks.all():
            return empty
        most = table.column("most")[0].as_py()
        sides = []
        for mine in (asks, ~asks):
            part = table.filter(pa.array(mine))
            lists = part.column("shingles").combine_chunks()
            sides.append((part.column("node").to_numpy(), part.column("component").to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)))
        (x, cx, nx, sx), (y, cy, ny, sy) = sides
        common = np.intersect1d(sx, sy)
        met = np.zeros((len(x), len(y)), np.float32)
        places = [(np.repeat(np.arange(len(n)), n), np.searchsorted(common, s), s) for n, s in ((nx, sx), (ny, sy))]
        for at in range(0, len(common), 4096):
            width = min(4096, len(common) - at)
            parts = []
            for (row, place, s), n in zip(places, (len(x), len(y))):
                here = np.flatnonzero((place >= at) & (place < at + width))
                here = here[common[place[here]] == s[here]]
                dense = np.zeros((n, width), np.float32)
                dense[row[here], place[here] - at] = 1
                parts.append(dense)
            met += parts[0] @ parts[1].T
        met = np.rint(met).astype(np.int64)
        linked = (100 * met >= percent * (nx[:, None].astype(np.int64) + ny[None, :] - met)) & (cx[:, None] != cy[None, :]) & ((cy == most)[None, :] | (x[:, None] < y[None, :]))
        i, j = np.nonzero(linked)
        return pa.table([pa.array(np.minimum(x[i], y[j])), pa.array(np.maximum(x[i], y[j]))], names=["a", "b"])

    return run


def _agreements(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def _any(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


class NearDuplicates:
    """Near-duplicate components of documents under a Jaccard similarity of percent / 100 or more."""

    def __init__(self, *, shingle_words: int = 5, percent: int = 80, n_coords: int = N_COORDS, matches: int = MATCHES, seed: int = 1) -> None:
        self.size, self.percent, self.n_coords, self.matches, self.seed = shingle_words, percent, n_coords, matches, seed

    def _prefixes(self, classes: DataFrame, scratch: Scratch) -> DataFrame:
        """token, node: the posting lists of two classes or more, without the skipped ones."""
        tokens = classes.select("node", F.posexplode("signature").alias("c", "v")).select("node", (F.col("c").cast("long") * (1 << 32) + F.col("v").cast("long").bitwiseAND((1 << 32) - 1)).alias("token"))
        lists = scratch.table(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
        shared = tokens.join(lists, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))
        # of n_coords tokens the n_coords - matches + 1 rarest are merged; those with a list of one come first and are in no pair
        merged = F.greatest(F.size("held") - F.lit(self.matches - 1), F.lit(0))
        out = scratch.table(shared.select("node", F.explode(F.slice("held", F.lit(1), merged)).alias("t")).select("t.token", "node"), "prefixes")
        scratch.drop(lists)
        return out

    def _bounded(self, lists: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
        """lists with size and shared, the most shingles that a class can have in common with another; without those that can't be similar to any."""
        own = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
        own = scratch.table(own.groupBy("node").agg(F.count(F.lit(1)).alias("own")), "own")
        bounds = sets.select("node", "first", F.size("shingles").alias("size")).join(own, "node", "left").select("node", "first", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared"))
        bounds = scratch.table(bounds.where(100 * F.col("shared") >= self.percent * F.col("size")), "bounds")
        return scratch.table(lists.join(bounds, "node").select("token", "node", "first", "size", "shared"), "lists")

    def _possible(self, x: str, y: str) -> Column:
        """Whether the bounds of two classes leave room for similarity."""
        sizes, met = F.col(f"size{x}") + F.col(f"size{y}"), F.least(f"shared{x}", f"shared{y}", f"size{x}", f"size{y}")
        return 100 * met >= self.percent * (sizes - met)

    def _confirmed(self, pairs: DataFrame, signatures: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
        """a, b of the pairs that agree in enough coordinates and are similar on their full sets."""
        near = pairs.join(signatures.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
        near = scratch.table(near, "left")
        near = near.join(signatures.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b").where(_agreements("sa", "sb") >= self.matches).select("a", "b")
        near = scratch.table(near, "agreeing")
        left = scratch.table(near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a"), "sets")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b")
        met = F.size(F.array_intersect("xa", "xb"))
        similar = 100 * met >= self.percent * (F.size("xa") + F.size("xb") - met)
        out = scratch.table(both.where(similar).select("a", "b"), "links")
        scratch.drop(near, left)
        return out

    def components(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
        scratch = Scratch(docs.sparkSession, "near")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        signed = scratch.table(texts.mapInArrow(_signatures(self.size, self.seed, self.n_coords, False), _SIGNED), "signed")
        judged = self._judged(signed, texts, scratch)
        return judged.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """The rows of docs without those whose text is near that of another row that stays; columns as they are."""
        scratch = Scratch(docs.sparkSession, "near")
        row = T.StructField("row", docs.schema)
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
        signed = scratch.table(rows.mapInArrow(_signatures(self.size, self.seed, self.n_coords, True), T.StructType([*_SIGNED, row])), "signed")
        texts = signed.select("doc_id", F.col("row.text").alias("text"))
        judged = self._judged(signed.drop("row"), texts, scratch)
        gone = scratch.table(judged.where("component_id is not null and n_shingles > 0 and not (leads and doc_id = component_id)").select("doc_id", *_KEY).distinct(), "gone")
        left = signed.join(gone, ["doc_id", *_KEY], "left_anti")
        again = left.where("doc_id is not null and n_shingles > 0").groupBy("doc_id", *_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        again = scratch.table(again, "again")
        if not _any(again):
            return left.select("row.*")
        once = left.join(again, ["doc_id", *_KEY], "left_semi").groupBy("doc_id", *_KEY).agg(F.first("row").alias("row"))
        return left.join(again, ["doc_id", *_KEY], "left_anti").select("row.*").unionByName(once.select("row.*"))

    def _judged(self, signed: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
        """signed with component_id, and leads: whether the row's class is the first of its component.

        A class is named by a number that is given as the table of classes is written, and its first
        doc_id; a doc_id may be the first of several classes.
        """
        named = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*_KEY).agg(F.min("doc_id").alias("first"), F.any_value("signature").alias("signature"))
        signatures = scratch.table(named.withColumn("node", F.monotonically_increasing_id()), "classes")
        named = signatures.drop("signature")
        lists = self._prefixes(signatures.select("node", "signature"), scratch)
        posted = scratch.table(named.join(lists.select("node").distinct(), "node", "left_semi"), "posted")
        # only texts of listed classes are shingled again: a bitmap of bounded size leaves out the others without a shuffle of texts
        bits = min(MAP_BITS, max(_BUCKET, 1 << (16 * posted.count()).bit_length()))
        wanted = _marked(posted.select(F.col("first").alias("doc_id")), bits)
        held = texts.where("doc_id is not null").select(F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("at"), "text")
        sets = held.mapInArrow(_sets(self.size, self.seed, wanted), "class_hi bigint, class_lo bigint, n_shingles bigint, shingles array<bigint>")
        sets = scratch.table(sets.dropDuplicates(_KEY).join(posted, _KEY).select("node", "first", "shingles"), "shingles")
        held = scratch.table(signatures.select("node", "signature").join(posted.select("node"), "node", "left_semi"), "held")
        links = self._linked(self._bounded(lists, sets, scratch), held, sets, scratch)
        labels = connected_components(links, scratch)
        in_component = named.join(labels, "node").select("node", "component", "first")
        heads = scratch.table(in_component.groupBy("component").agg(F.min(F.struct("first", "node")).alias("head")), "heads")
        led = labels.join(heads, "component").select(F.col("node").alias("n"), "head")
        resolved = named.join(led, named["node"] == led["n"], "left").select(*_KEY, F.coalesce("head.first", "first").alias("component_id"), F.coalesce(F.col("head.node") == F.col("node"), F.lit(True)).alias("leads"))
        resolved = scratch.table(resolved, "resolved").withColumnsRenamed({k: f"__{k}" for k in _KEY})
        same = [signed[k] == resolved[f"__{k}"] for k in _KEY]
        out = signed.join(resolved, same, "left").withColumn("component_id", F.when(signed["doc_id"].isNotNull(), F.coalesce("component_id", "doc_id")))
        return out.select("doc_id", *_KEY, "component_id", F.coalesce("leads", F.lit(True)).alias("leads"))

    def _linked(self, lists: DataFrame, signatures: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
        """a, b: links enough to join all classes of a component."""
        # the class that came first is the pivot: copies are made of what was there, so it's the same one in most of a group's lists
        pivots = scratch.table(lists.groupBy("token").agg(F.min_by("node", "first").alias("pivot")), "pivots")
        pairs = scratch.table(lists.join(pivots, "token").where("node <> pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct(), "pairs")
        links = self._confirmed(pairs, signatures, sets, scratch)
        open_ = self._open_lists(lists, connected_components(links, scratch), scratch)
        if not _any(open_):
            return links
        side = lambda x: [F.col(c).alias(f"{c}{x}") for c in ("node", "component", "size", "shared")]
        pivot = open_.where("component <> most").groupBy("token").agg(F.max_by(F.struct(*side("x")), F.xxhash64("node", "token")).alias("p")).select("token", "p.*")
        more = scratch.table(pivot, "pivots").join(open_.select("token", "n", *side("y")), "token").where("componentx <> componenty").where(self._possible("x", "y"))
        more = more.select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct()
        more = scratch.table(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
        if _any(more):
            links = scratch.table(links.unionByName(self._confirmed(more, signatures, sets, scratch)), "links")
            open_ = self._open_lists(lists, connected_components(links, scratch), scratch)
            if not _any(open_):
                return links
        return scratch.table(links.unionByName(self._in_blocks(open_, sets, scratch)), "links")

    @staticmethod
    def _open_lists(lists: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
        """token, node, component, most, n of the lists with two components or more; most is the one with most classes."""
        held = scratch.table(lists.join(labels, "node", "left").select("token", "node", "size", "shared", F.coalesce("component", "node").alias("component")), "labelled")
        return scratch.table(held.join(scratch.table(NearDuplicates._mixed(held, ["token"]), "mixed"), "token"), "open")

    @staticmethod
    def _mixed(rows: DataFrame, by: list[str]) -> DataFrame:
        """by, n, most of the groups with two components or more."""
        n = rows.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("k"))
        return n.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max_by("component", F.struct("k", "component")).alias("most")).where("n > 1")

    def _in_blocks(self, open_: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
        """a, b: the links that remain between components of open lists.

        The classes of lists with the same largest component are one group. Its classes outside that
        component are a query set, met with all of the group in blocks; a block's intersections are one
        matrix product, and only links leave it. Large groups are dealt by their prefixes' shingles first.
        """
        nodes = self._sized(open_.select("most", F.lit(0).cast("long").alias("part"), "node", "component", "size").distinct(), scratch)
        rare = F.greatest(F.col("size") - F.ceil(F.col("size") * self.percent / 100) + 1, F.lit(1)).cast("int")
        large = nodes.where("blocks > reach").select("most", "node", "component", "size")
        met = nodes.where("blocks <= reach")
        if _any(large):
            large = scratch.table(large, "large")
            asked = large.join(sets, "node").select("most", "node", F.explode("shingles").alias("s"))
            often = scratch.table(asked.groupBy("most", "s").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
            # shingles that one class of the group has come first in its prefix, and lead to nobody
            ordered = asked.join(often, ["most", "s"]).groupBy("most", "node").agg(F.sort_array(F.collect_list(F.struct("often", "s"))).alias("held"))
            ordered = ordered.join(large, ["most", "node"]).withColumn("held", F.slice("held", F.lit(1), F.greatest(rare - (F.col("size") - F.size("held")), F.lit(0)).cast("int")))
            rows = scratch.table(ordered.select(F.col("most").alias("g"), "node", "component", "size", F.explode("held.s").alias("part")), "prefixes")
            mixed = scratch.table(self._mixed(rows, ["g", "part"]).select("g", "part", "most"), "mixed")
            dealt = self._sized(rows.join(mixed, ["g", "part"]).select("most", "part", "node", "component", "size", "g"), scratch)
            met = met.unionByName(dealt.select(met.columns))
        others = F.sequence(F.lit(0), F.col("blocks") - 1)
        query = met.where("component <> most").select("g", "part", "most", "node", "component", F.col("own").alias("i"), F.explode(others).alias("j"), F.lit(True).alias("asks"))
        rows = met.select("g", "part", "most", "node", "component", F.explode(others).alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"))
        blocks = scratch.table(query.unionByName(rows), "blocks").join(sets, "node")
        return blocks.groupBy("g", "part", "i", "j").applyInArrow(_links(self.percent), "a bigint, b bigint")

    def _sized(self, nodes: DataFrame, scratch: Scratch) -> DataFrame:
        """nodes with g (the group's name), the number of blocks of their group, their own block, and reach: the mean length of a prefix in the group."""
        nodes = nodes if "g" in nodes.columns else nodes.withColumn("g", F.col("most"))
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES), F.lit(1)).cast("int")
        reach = (F.avg("size") * (100 - self.percent) / 100 + 1).alias("reach")
        sized = nodes.groupBy("g", "part").agg(blocks.alias("blocks"), reach)
        return scratch.table(nodes.join(sized, ["g", "part"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "grouped")
