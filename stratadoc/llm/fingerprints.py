"""Document fingerprints by a homomorphic multiset hash, in DataFrame expressions only.

A text is a multiset of paragraphs (its \\n-split lines, and in these the runs between sentence
ends). Every paragraph is hashed to a wide vector; the fingerprint is the sum of the vectors, each
lane modulo 2**LANE_BITS. So the order of paragraphs doesn't matter, and a paragraph is inserted
or deleted by adding or subtracting its vector: combine() and retract() work on fingerprints alone.

Beside the EXACT lanes, into which every paragraph is hashed densely and which decide equality,
there are SPREAD lanes of counts modulo 2**32: a paragraph adds its length in characters to one of
them, or takes it away, as its hash says. The product of two vectors of counts estimates the text
that two multisets share, since what they don't share cancels out; likeness is that product over
the larger of both squares, 0 for nothing in common (the error is about 1 / sqrt(SPREAD)).

Defined results: a null text is an empty one; an empty text is the multiset of one empty paragraph.
Equal texts have equal fingerprints and a likeness of 1. Very long texts are hashed whole, as any
other: a paragraph's length counts in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

EXACT, LANE_BITS, SPREAD, COUNT_BITS = 12, 56, 128, 32
_MASK, _COUNT_MASK = (1 << LANE_BITS) - 1, (1 << COUNT_BITS) - 1
#: Counts are held two to a long; the lengths of a text's paragraphs add up to less than half of 2**32.
_PACK = 2
#: A paragraph ends at a line break, a sentence at one of these and a space.
_ENDS = r"\n|(?<=[.!?]) "


def _low() -> Column:
    return F.lit(_COUNT_MASK).cast("long")


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), _ENDS)


def _spread(parts: Column) -> Column:
    """The SPREAD counts, two to a long; each paragraph is coded as its lane over its signed length modulo 2**32."""

    def code(p: Column) -> Column:
        size = F.length(p).cast("long")
        return let(
            F.xxhash64(p),
            lambda h: F.shiftleft(F.pmod(h, F.lit(SPREAD)), 32).bitwiseOR(F.when(F.shiftright(h, 40).bitwiseAND(F.lit(1).cast("long")) == 1, -size).otherwise(size).bitwiseAND(_low())),
        )

    def add(acc: Column, c: Column) -> Column:
        """acc with the value of c added at its place; what stands at the other places stays."""
        return let(
            F.shiftright(c, 32).bitwiseAND(F.lit(_PACK - 1).cast("long")).cast("int") * COUNT_BITS,
            lambda at: F.call_function("shiftleft", (F.call_function("shiftrightunsigned", acc, at).bitwiseAND(_low()) + c.bitwiseAND(_low())).bitwiseAND(_low()), at).bitwiseOR(
                acc.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", _low(), at)))
            ),
        )

    words = F.sequence(F.lit(0).cast("long"), F.lit(SPREAD // _PACK - 1).cast("long"))
    return let(F.transform(parts, code), lambda codes: F.transform(words, lambda w: F.aggregate(F.filter(codes, lambda c: F.shiftright(c, 33) == w), F.lit(0).cast("long"), add)))


def fingerprint(text: Column) -> Column:
    """array<bigint>: EXACT lanes, then the packed counts."""

    def of(parts: Column) -> Column:
        add = lambda k: F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: (acc + F.xxhash64(F.lit(k), p).bitwiseAND(F.lit(_MASK))).bitwiseAND(F.lit(_MASK)))
        return F.concat(F.array(*(add(k) for k in range(EXACT))), _spread(parts))

    return let(paragraphs(text), of)


def _lanes(print_: Column) -> tuple[Column, Column]:
    return F.slice(print_, 1, EXACT), F.slice(print_, EXACT + 1, SPREAD // _PACK)


def counts(print_: Column) -> Column:
    """The SPREAD counts of a fingerprint, as signed numbers."""
    half = 1 << (COUNT_BITS - 1)
    part = lambda x, k: (F.shiftrightunsigned(x, COUNT_BITS * k).bitwiseAND(_low()) + half).bitwiseAND(_low()) - half
    return F.flatten(F.transform(_lanes(print_)[1], lambda x: F.array(*(part(x, k) for k in range(_PACK)))))


def _by_lane(a: Column, b: Column, sign: int) -> Column:
    exact = F.zip_with(_lanes(a)[0], _lanes(b)[0], lambda x, y: (x + sign * y).bitwiseAND(F.lit(_MASK)))

    def each(x: Column, y: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(_PACK):
            part = lambda v: F.shiftrightunsigned(v, COUNT_BITS * k).bitwiseAND(F.lit(_COUNT_MASK).cast("long"))  # noqa: E731, B023
            out = out.bitwiseOR(F.shiftleft((part(x) + sign * part(y)).bitwiseAND(F.lit(_COUNT_MASK).cast("long")), COUNT_BITS * k))
        return out

    return F.concat(exact, F.zip_with(_lanes(a)[1], _lanes(b)[1], each))


def combine(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return _by_lane(a, b, 1)


def retract(a: Column, b: Column) -> Column:
    """The fingerprint of a's multiset without b's."""
    return _by_lane(a, b, -1)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 for equal fingerprints."""

    def of(both: Column) -> Column:
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda acc, z: acc + z)
        x, y = both["x"], both["y"]
        most = F.greatest(dot(x, x), dot(y, y))
        return F.when(most == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), dot(x, y) / most))

    return F.when(a == b, F.lit(1.0)).otherwise(let(F.struct(counts(a).alias("x"), counts(b).alias("y")), of))


def as_string(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.hex(x), 16, "0")), "")


#: Rows of a bucket of neighbours, about; more where there are more than MOST_BUCKETS of these.
BUCKET_ROWS, MOST_BUCKETS = 512, 65_536
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _cuts(quantiles: list[int]) -> list[tuple[int, int]]:
    """Starts of buckets (key, tie): a key that is several quantiles is cut into as many ranges of ties."""
    times: dict[int, int] = {}
    for q in quantiles:
        times[q] = times.get(q, 0) + 1
    return [(q, _LEAST + (j << 64) // n) for q, n in sorted(times.items()) for j in range(n)]


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text", *, derive: dict[str, Column] | None = None) -> DataFrame:
    """df with __next, the text of the row that follows by key (after the last: of the first), and __next_<name>
    for columns derived from the row.

    Rows are dealt to buckets between quantiles of the key, and of the text's hash where one key (or none)
    has several buckets' rows. The first rows of a bucket are given to the bucket before as well, so that
    no window sees more than a bucket and a text is shuffled once. Equal keys follow each other in the
    order of their text's hash; rows without a key come last. Identical rows are in one bucket.
    """
    low = F.coalesce(F.col(key).cast("long"), F.lit(_MOST))
    ids = df.select(low.alias("k"))
    n = ids.count()
    n_buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    cuts = _cuts(ids.agg(F.percentile_approx("k", [i / n_buckets for i in range(1, n_buckets)], 100_000)).first()[0] or [] if n_buckets > 1 else [])
    hot = len({k for k, _ in cuts}) < len(cuts)
    tie = F.xxhash64(text) if hot else F.lit(0).cast("long")

    longs = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # noqa: E731  folded to one literal

    def place(key_: Column, tie_: Column) -> Column:
        """The number of cuts that are at most the row's, by halving."""
        if not cuts:
            return F.lit(0).cast("bigint")
        keys, ties = longs([k for k, _ in cuts]), longs([t for _, t in cuts])

        def halve(acc: Column, _: Column) -> Column:
            middle = F.shiftright(acc["lo"] + acc["hi"], 1)
            right = key_ >= F.get(keys, middle) if not hot else (key_ > F.get(keys, middle)) | ((key_ == F.get(keys, middle)) & (tie_ >= F.get(ties, middle)))
            open_ = acc["lo"] < acc["hi"]
            return F.struct(F.when(open_ & right, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~right, middle).otherwise(acc["hi"]).alias("hi"))

        start = F.struct(F.lit(0).cast("bigint").alias("lo"), F.lit(len(cuts)).cast("bigint").alias("hi"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, halve, lambda acc: acc["lo"])

    placed = df.select(low.alias("k"), tie.alias("t"))
    heads = [(b, h["k"], h["t"]) for b, h in placed.groupBy(place(F.col("k"), F.col("t")).alias("b")).agg(F.min(F.struct("k", "t"))).orderBy("b").collect()]
    # the first rows of a bucket also go to the one before; those of the first bucket to the last, behind all others
    earlier, head_k, head_t = ([0] * (len(cuts) + 1) for _ in range(3))
    for i, (b, k, t) in enumerate(heads):
        earlier[b], head_k[b], head_t[b] = heads[i - 1][0], k, t
    home = lambda b: F.struct(b.alias("b"), F.lit(False).alias("wrap"), F.lit(False).alias("copy"))
    copy = lambda b: F.struct(F.get(longs(earlier), b).alias("b"), (b == (heads[0][0] if heads else 0)).alias("wrap"), F.lit(True).alias("copy"))
    leads = lambda b: (F.col("__k") == F.get(longs(head_k), b)) & (F.col("__cut") == F.get(longs(head_t), b))
    places = let(place(F.col("__k"), F.col("__cut")), lambda b: F.when(leads(b), F.array(home(b), copy(b))).otherwise(F.array(home(b))))
    dealt = df.withColumn("__k", low).withColumn("__cut", tie).withColumn("__at", F.explode(places)).withColumn("__tie", F.xxhash64(text))
    dealt = dealt.withColumns({"__b": F.col("__at.b"), "__wrap": F.col("__at.wrap"), "__copy": F.col("__at.copy")}).drop("__at", "__cut")
    order = Window.partitionBy("__b").orderBy("__wrap", "__k", "__tie")
    out = dealt.withColumn("__next", F.lead(F.coalesce(text, F.lit(""))).over(order)).withColumns(derive or {})
    out = out.withColumns({f"__next_{name}": F.lead(name).over(order) for name in derive or {}})
    return out.where("not __copy").drop("__k", "__b", "__wrap", "__copy", "__tie")
