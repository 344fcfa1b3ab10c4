"""Near-duplicate documents by SetSketch registers.

A document's set holds the 64-bit hashes of its word shingles. Its sketch has REGISTERS one-byte
registers: each is the minimum over the set of exponential variables, on an exponentially spaced
scale of base BASE, truncated to 0..255. Registers merge by maximum and two of them agree with a
probability close to the Jaccard similarity. BANDS bands of 8 registers give bucket keys: a pair of
similarity 0.8 shares no bucket with a probability of 4e-6. Candidates pass a joint likelihood
estimate (4.5 standard errors below the threshold); every link is confirmed on the full sets.

Equal sets are one node. In a bucket every node is first held against the bucket's head, the one that
meets the most others. Nodes held against the same head that are still in different components, and that
the triangle inequality and the sketches allow to be linked, are then held against each other in blocks of
bounded size, the likeliest first and none that are connected by then. Nodes of a head's largest component are
connected already, so only the others meet all: a crowd with few outliers costs in proportion to its size. A group
of near copies gives links in proportion to its size, and no link between components is missed.

Buckets and heads of any size are dealt out: their one row of summary is broadcast to them when they are heavy
(``common.join_groups``), and the head's set goes to slices of SLICE members.

Defined results: null and empty texts have no set and are linked with nothing; a text of fewer words
than the shingle is one shingle; rows with null ids take part, a component's id is its least
non-null id; an empty table gives an empty result; other columns are ignored, or carried by
``near_dedup`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import common as C
from orrery.llm import graph, hashing

REGISTERS, WIDTH, BASE, RATE = 512, 8, 1.1, 1 / 32
#: Members of a head's group that are held against each other at once, and shingles of theirs.
PIECE, PIECE_ITEMS = 512, 4_000_000
#: Members of a head's group that meet one copy of the head's set.
SLICE = 256
#: An estimate may be so much below the threshold: 4.5 standard errors at 0.8.
MARGIN = 4.5 * (0.8 * 0.2 / REGISTERS) ** 0.5
_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_MUL = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes, as uint8."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), 128):
        np.minimum(least, ((x[k : k + 128, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    e = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(RATE * e) / np.log(BASE)), 0, 255).astype(np.uint8)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def estimate(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity given how many registers of a are above and below those of b.

    Joint likelihood for known set sizes, on a grid of 201 values up to the largest one possible.
    """
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    up, down = _p(np.maximum(u - v * j, 1e-12)), _p(np.maximum(v - u * j, 1e-12))
    same = np.maximum(1 - up - down, 1e-12)
    equal = REGISTERS - above - below
    like = above[:, None] * np.log(up) + below[:, None] * np.log(down) + equal[:, None] * np.log(same)
    return j[np.arange(len(u)), like.argmax(axis=1)]


def _sets(texts: list, width: int) -> Iterator[np.ndarray]:
    for lo, hi in hashing.in_pieces(texts):
        words, at = hashing.word_hashes(texts[lo:hi])
        for k in range(hi - lo):
            yield np.unique(hashing.shingle_hashes(words[at[k] : at[k + 1]], width))


def _class(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _with_sketch(width: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in C.in_pieces(whole)):
            texts = batch.column("text").to_pylist()
            n, cls, regs = [], [], []
            for s in _sets(texts, width):
                n.append(len(s))
                cls.append(_class(s))
                regs.append(sketch(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(regs, pa.list_(pa.int64()))],
                names=["doc_id", "row_key", "n", "cls", "regs"],
            )

    return f


def _with_set(width: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in C.in_pieces(whole, most=1 << 20)):
            sets = list(_sets(batch.column("text").to_pylist(), width))
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(_class, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "items"]
            )

    return f


def _shared(a: bytes, b: bytes) -> int:
    return len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))


def _common(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs with both sets -> a, b, common, all: the sizes of intersection and union."""
    for pdf in frames:
        pdf = pdf.assign(common=np.array(list(map(_shared, pdf["items_a"], pdf["items_b"])), dtype=np.int64))
        yield pdf.assign(**{"all": pdf["n_a"] + pdf["n_b"] - pdf["common"]})[["a", "b", "common", "all"]]


class _Forest:
    """Components of a block's members: those known before, and what links found in the block add."""

    def __init__(self, labels: np.ndarray):
        self.of = labels.copy()

    def join(self, i: int, j: int) -> None:
        self.of[self.of == self.of[j]] = self.of[i]


def _cross(percent: int):
    """Members of a head's group, sorted by piece pair -> confirmed links between different components.

    Of a piece pair, members outside the largest component (``asks``) are held against the others. Size, distance
    to the head and the sketches say which pairs can be linked; the likeliest are confirmed first on the full sets,
    and pairs that a found link has connected are left out. So a block of members gives fewer links than it has
    members.
    """
    least = percent / 100 - MARGIN

    def links(label, n, far, asks, regs, items) -> Iterator[tuple[int, int]]:
        forest = _Forest(label)
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        one = not len(right)  # a piece with itself
        right = left if one else right
        for lo in range(0, len(left), 256):
            me = left[lo : lo + 256]
            ok = forest.of[me, None] != forest.of[None, right]
            ok &= 100 * np.minimum(n[me, None], n[None, right]) >= percent * np.maximum(n[me, None], n[None, right])
            ok &= np.abs(far[me, None] - far[None, right]) <= 1 - percent / 100 + 1e-9
            if one:
                ok &= me[:, None] < right[None, :]
            i, j = np.nonzero(ok)
            i, j = me[i], right[j]
            for at in range(0, len(i), 10_000):
                x, y = i[at : at + 10_000], j[at : at + 10_000]
                apart = forest.of[x] != forest.of[y]
                x, y = x[apart], y[apart]
                a, b = regs[x], regs[y]
                above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
                near = np.flatnonzero(above + below <= REGISTERS * (1 - least))
                if not len(near):
                    continue
                like = estimate(above[near], below[near], n[x[near]], n[y[near]])
                for k in near[np.argsort(-like, kind="stable")[: int((like >= least).sum())]]:
                    p, q = int(x[k]), int(y[k])
                    if forest.of[p] != forest.of[q]:
                        common = _shared(items[p], items[q])
                        if 100 * common >= percent * (n[p] + n[q] - common):
                            forest.join(p, q)
                            yield p, q

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def ends(t: pa.Table) -> np.ndarray:
            """Where a new group starts."""
            head, p, q = np.array(t.column("head").to_pylist(), dtype=object), t.column("p").to_numpy(), t.column("q").to_numpy()
            return np.flatnonzero((head[1:] != head[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1

        def work(t: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
            cls, items = t.column("cls").to_pylist(), t.column("items").to_pylist()
            label = np.unique(np.array(t.column("label").to_pylist(), dtype=object), return_inverse=True)[1]
            n, far = (t.column(c).to_numpy() for c in ("n", "far"))
            asks = t.column("asks").to_numpy()
            regs = t.column("regs").combine_chunks().flatten().to_numpy().view(np.uint8).reshape(len(t), REGISTERS)
            out = []
            for lo, hi in zip([0, *cuts], [*cuts, len(t)], strict=True):
                if hi - lo > 1:
                    s = slice(lo, hi)
                    for i, j in links(label[s], n[s].astype(np.int64), far[s], asks[s], regs[s], items[s]):
                        out.append(sorted((cls[lo + i], cls[lo + j])))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            cuts = ends(t)
            if len(cuts):
                yield work(t.slice(0, int(cuts[-1])), cuts[:-1])
                t = t.slice(int(cuts[-1]))
            held = t
        if held is not None and len(held):
            yield work(held, np.zeros(0, np.int64))

    return f


def _compare(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs (head a, member b) with the sizes of their sets' intersection and union; heads may have any number of members."""
    counts = C.cut(pairs.groupBy("a").agg(F.count("*").alias("k")))
    total = counts.agg(F.sum("k")).first()[0] or 0
    slices = F.ceil(F.col("k") / SLICE)
    asked = C.join_groups(pairs, counts, "a", "k", total).select("a", "b", F.pmod(F.xxhash64("b"), slices).alias("slice"))
    sides = [full.select(F.col("cls").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "items"))) for s in "ab"]
    heads = counts.join(sides[0], "a").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).drop("k")
    return asked.join(sides[1], "b").join(heads, ["a", "slice"]).mapInPandas(C.lean(_common), "a binary, b binary, common long, all long")


def _one_head(links: DataFrame) -> DataFrame:
    """Links (head a, member b) -> as few that connect the same: each member with its least head, and this head with the others.

    A member has at most a head for each band, and equal links of two heads become one; so what a large group of copies hands
    on is a link for each member and those between heads, not a link for each member and head.
    """
    least = F.min("a").over(Window.partitionBy("b"))
    return links.withColumn("m", least).select(F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct()


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, row_key, n_shingles, component_id, first (it stays)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), C.row_key(id_col, text_col).alias("row_key"))
    rows = C.cut(
        slim.mapInArrow(C.lean(_with_sketch(width)), "doc_id long, row_key binary, n long, cls binary, regs array<long>").withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    total = rows.count()
    classes = C.cut(
        rows.filter("cls IS NOT NULL")
        .groupBy("cls")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"), F.count("*").alias("members"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    )
    keys = classes.select("cls", F.posexplode("regs").alias("band", "part")).select("cls", F.xxhash64("band", "part").alias("key"))
    shared = C.cut(keys.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1"))
    held = shared.agg(F.sum("k")).first()[0] or 0
    bands = C.cut(C.join_groups(keys, shared, "key", "k", held))
    # a bucket's head is the member that meets the most others in all its buckets: near the middle of its group
    meets = bands.groupBy("cls").agg(F.sum("k").alias("meets"))
    heads = C.cut(bands.join(meets, "cls").groupBy("key").agg(F.max(F.struct("meets", "cls")).alias("head"), F.count("*").alias("k")))
    bands = C.cut(C.join_groups(bands.select("key", "cls"), heads, "key", "k", held).select(F.col("head.cls").alias("a"), F.col("cls").alias("b")).distinct())
    # the sets of the classes that share a bucket: a bounded filter drops most other rows before the shuffle
    wanted = bands.select(F.col("b").alias("cls")).distinct()  # heads are members too
    blocks = C.filter_blocks(total)
    sets = slim.select("text").mapInArrow(C.lean(_with_set(width)), "cls binary, items binary").filter("cls IS NOT NULL")
    sets = C.probe(sets, "cls", C.member_filter(wanted, "cls", blocks), blocks, "wanted").filter("wanted")
    full = C.cut(sets.groupBy("cls").agg(F.first("items").alias("items")).join(classes.select("cls", "n", "regs"), "cls").join(wanted, "cls", "left_semi"))
    linked = f"100 * common >= {percent} * all"
    star = C.cut(_compare(bands.filter("a <> b"), full))
    links = star.filter(linked).select("a", "b")
    label = graph.components(_one_head(links))
    # What was held against the same head and is not connected yet. Jaccard distance is a metric: two whose
    # distances to the head differ by more than the limit cannot be linked.
    placed = star.select(F.col("a").alias("head"), F.col("b").alias("cls"), (1 - F.col("common") / F.col("all")).alias("far"))
    placed = C.cut(
        placed.join(label, placed.cls == label.node, "left")
        .select("head", "cls", "far", F.coalesce("label", "cls").alias("label"))
        .join(full.select("cls", "n"), "cls")
    )
    by_label = placed.groupBy("head", "label").agg(F.count("*").alias("k"), F.sum("n").alias("sum"))
    mixed = by_label.groupBy("head").agg(
        F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("k"), F.sum("sum").alias("sum"), F.max_by("sum", F.struct("k", "label")).alias("most_sum")
    )

    def pieces(k, items):
        return F.greatest(F.ceil(k / PIECE), F.ceil(items / PIECE_ITEMS))

    mixed = C.cut(
        mixed.filter("k > most.k").select(
            "head", "k", F.col("most.label").alias("most"), pieces(F.col("k") - F.col("most.k"), F.col("sum") - F.col("most_sum")).alias("few"), pieces(F.col("most.k"), F.col("most_sum")).alias("many")
        )
    )
    parts = C.join_groups(placed, mixed, "head", "k", placed.count())
    # pieces 0 to few - 1 are of members outside the largest component: every two of them meet, and each meets the others
    h, zero = F.xxhash64("cls"), F.lit(0).cast("long")
    own, other = F.pmod(h, F.col("few")), F.col("other")
    asks = parts.filter("label <> most").withColumn("other", F.explode(F.sequence(zero, F.col("few") + F.col("many") - 1)))
    asks = asks.withColumns({"p": F.least(own, other), "q": F.greatest(own, other), "asks": own <= other}).drop("other")
    others = parts.filter("label = most").withColumns({"q": F.col("few") + F.pmod(h, F.col("many")), "asks": F.lit(False)})
    others = others.withColumn("p", F.explode(F.sequence(zero, F.col("few") - 1)))
    dealt = asks.unionByName(others).join(full.drop("n"), "cls").select("head", "p", "q", "asks", "cls", "label", "n", "far", "regs", "items")
    dealt = dealt.repartition("head", "p", "q").sortWithinPartitions("head", "p", "q")
    rest = dealt.mapInArrow(C.lean(_cross(percent)), "a binary, b binary")
    # the components so far are stars already: few rounds are left
    label = graph.components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(rest))
    # back to documents
    placed = C.cut(classes.join(label, classes.cls == label.node, "left").select("cls", "least", "members", F.coalesce("label", "cls").alias("label")))
    heads = C.cut(placed.groupBy("label").agg(F.min("least").alias("head"), F.count("*").alias("k")))
    placed = C.cut(C.join_groups(placed, heads, "label", "k", total).select("cls", "members", "head"))
    found = C.join_groups(rows.drop("regs"), placed, "cls", "members", total)
    alone = rows.filter("cls IS NULL")
    return found.select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"), F.col("head.doc_id").alias("component_id"), (F.col("head.row") == F.col("row")).alias("first")
    ).unionByName(
        alone.select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    )


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one of each group, with all their columns."""
    groups = C.cut(near_groups(docs, width, percent, id_col, text_col).select("row_key", "first"))
    return C.keep_rows(docs, groups, "first", id_col, text_col)
