"""Hard negatives by rotated one-bit codes, whose intervals are certain, and integer scores of what they leave."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded
from tessera.llm.topk import _matrix, _pack, _unpack, products
from tessera.operators.order import numbered
from tessera.session import write_table

#: Vectors of a block, blocks of a page, pages of a sheet, anchors of a chunk, pivots that order the vectors.
BLOCK, PAGE, SHEET, CHUNK, PIVOTS = 256, 8, 256, 128, 64
#: Chunks that meet a page (or a sheet) in one group; pages of each sheet that are scored first for each anchor.
TOGETHER, FIRST = 16, 2
#: Bits of a rotated component of an anchor.
PLANES = 6
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Relative and absolute room for rounding in the intervals.
_ROOM, _LEAST_ROOM = 1e-9, 1e-6


def fit(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """``row, vec_id, label, terms``: a number and each component x as floor(scale * x), of the rows that take part."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~odd)
    terms = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return whole.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), terms.alias("terms"))


def rotation(width: int) -> np.ndarray:
    """A random rotation, the same in every task."""
    return np.linalg.qr(np.random.default_rng(width).normal(size=(width, width)))[0]


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits of each row in 64-bit words."""
    packed = np.packbits(bits, axis=1)
    out = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _popcounts(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits that each row of ``left`` and each of ``right`` have in common."""
    out = np.zeros((len(left), len(right)), np.int64)
    for w in range(left.shape[1]):
        out += np.bitwise_count(left[:, w][:, None] & right[:, w][None, :])
    return out


class Codes:
    """One bit for each rotated component of what vectors have besides their centre.

    With u the direction from the centre, z its rotation and x the signs of z at length one,
    ``align`` is the product of x and z. Then z is align * x and a residual across x of length
    sqrt(1 - align^2), so for any y the product of z and y is align * <x, y>, give or take that
    length times the length of y across x, by Cauchy and Schwarz.
    """

    def __init__(self, terms: np.ndarray, turn: np.ndarray):
        whole = terms.astype(np.float64)
        self.centre = whole.mean(axis=0)
        apart = whole - self.centre
        self.norm = np.sqrt((apart * apart).sum(axis=1))
        turned = (apart / np.where(self.norm > 0, self.norm, 1)[:, None]) @ turn.T
        self.bits = _words(turned >= 0)
        self.align = np.abs(turned).sum(axis=1) / np.sqrt(len(turn))

    def packed(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.centre, self.norm, self.align, self.bits))

    @classmethod
    def unpacked(cls, blob: bytes, n: int, width: int) -> Codes:
        self, numbers = cls.__new__(cls), np.frombuffer(blob, np.float64, width + 2 * n)
        self.centre, self.norm, self.align = numbers[:width], numbers[width : width + n], numbers[width + n :]
        self.bits = np.frombuffer(blob, np.uint64, offset=8 * (width + 2 * n)).reshape(n, -1)
        return self


class Asked:
    """Anchors with their rotated components in bit planes."""

    def __init__(self, terms: np.ndarray, turn: np.ndarray):
        self.terms, self.whole = terms, terms.astype(np.float64)
        self.norm = np.sqrt((self.whole * self.whole).sum(axis=1))
        turned = self.whole @ turn.T
        self.least = turned.min(axis=1)
        self.step = (turned.max(axis=1) - self.least) / (2**PLANES - 1)
        near = np.rint((turned - self.least[:, None]) / np.where(self.step > 0, self.step, 1)[:, None]).astype(np.int64)
        shown = self.least[:, None] + self.step[:, None] * near
        self.planes = [_words((near >> p) & 1) for p in range(PLANES)]
        self.sum, self.square = shown.sum(axis=1), (shown * shown).sum(axis=1)
        self.error = np.sqrt(((turned - shown) ** 2).sum(axis=1))

    def intervals(self, live: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """What the products of anchors ``live`` and the coded vectors are at least and at most."""
        width = self.terms.shape[1]
        shared = sum((_popcounts(plane[live], codes.bits) << p for p, plane in enumerate(self.planes)), start=0)
        ones = np.bitwise_count(codes.bits).sum(axis=1, dtype=np.int64)
        held = self.least[live][:, None] * ones[None, :] + self.step[live][:, None] * shared
        along = (2 * held - self.sum[live][:, None]) / np.sqrt(width)
        across = np.sqrt(np.maximum(self.square[live][:, None] - along * along, 0))
        half = np.sqrt(np.clip(1 - codes.align**2, 0, None))[None, :] * across + self.error[live][:, None]
        base = (self.whole[live] @ codes.centre)[:, None]
        middle, half = base + codes.norm[None, :] * (codes.align[None, :] * along), codes.norm[None, :] * half
        half += _ROOM * self.norm[live][:, None] * (codes.norm[None, :] + np.sqrt((codes.centre**2).sum())) + _LEAST_ROOM
        return middle - half, middle + half

    def around(self, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the products with any vectors within ``radii`` of ``centres`` are at least and at most."""
        base = self.whole @ centres.T
        half = self.norm[:, None] * (radii + _ROOM * (radii + np.sqrt((centres**2).sum(axis=1))))[None, :] + _LEAST_ROOM
        return base - half, base + half


def _certain(terms: np.ndarray, others: np.ndarray) -> None:
    if float(np.abs(terms.astype(np.float64)).max(initial=0)) * float(np.abs(others.astype(np.float64)).max(initial=0)) * max(terms.shape[1], 1) >= 2.0**62:
        raise OverflowError("inner products of these vectors don't fit 64 bits")


def _packed(table: DataFrame, size: int, turn, name: str, width: int) -> DataFrame:
    """Blocks of ``size`` rows in order of label and nearest pivot: ``block, n, rows, ids, labels, terms, codes``."""

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # so that the first of equal scores has the least id
        terms = _matrix(rows.column("terms").combine_chunks(), width)
        values = [rows.column(c).to_numpy().astype(np.int64).tobytes() for c in ("row", "vec_id", "label")]
        blobs = [*values, _pack(terms), Codes(terms, turn.value).packed()]
        return pa.table({"block": [key[0].as_py()], "n": pa.array([rows.num_rows], pa.int32()), **{c: [b] for c, b in zip(("rows", "ids", "labels", "terms", "codes"), blobs, strict=True)}})

    placed = numbered(table, "label", "cell", "near", "vec_id", "row").withColumn("block", F.floor((F.col("position") - 1) / size).cast("long"))
    return write_table(placed.groupBy("block").applyInArrow(pack, "block bigint, n int, rows binary, ids binary, labels binary, terms binary, codes binary"), name)


def _best(scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of each row's k highest scores that are ok, of equal ones the first; and the scores, or _LEAST."""
    left = np.where(ok, scores, _LEAST)
    at, found, lines = np.zeros((len(left), k), np.int64), np.full((len(left), k), _LEAST), np.arange(len(left))
    for i in range(min(k, left.shape[1])):
        at[:, i] = left.argmax(axis=1)
        found[:, i] = left[lines, at[:, i]]
        left[lines, at[:, i]] = _LEAST
    return at, found


class Targets:
    """For each anchor of a chunk some ranges of scores, of each of which the k highest are asked for."""

    def __init__(self, row: dict):
        shape = row["q_n"], -1
        self.low, self.high = (np.frombuffer(row[c], np.int64).reshape(shape).copy() for c in ("low", "high"))

    def reached(self, least: np.ndarray, most: np.ndarray, live: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Whether products between ``least`` and ``most`` may lie in any of the anchor's ranges."""
        out = np.zeros(least.shape, bool)
        for low, high in zip(self.low[live].T, self.high[live].T, strict=True):
            out |= (most >= low[:, None]) & (least <= high[:, None])
        return out


def _met(page: list[dict], asked: list[dict], turn: np.ndarray, k: int, same: bool) -> pa.Table:
    """The k highest scores of each target of each wanted anchor among a page's vectors.

    Blocks come in falling order of their bound. Codes decide which vectors may lie in a range and
    reach its k-th score so far; these are scored.
    """
    names = ("chunk", "query_row", "query_id", "target", "vec_id", "vec_row", "score")
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] * len(names)]
    held = []
    for b in page:
        rows, ids, labels = (np.frombuffer(b[c], np.int64) for c in ("rows", "ids", "labels"))
        held.append((rows, ids, labels, terms := _unpack(b["terms"], b["n"]), Codes.unpacked(b["codes"], b["n"], terms.shape[1])))
    centres, radii = np.stack([h[4].centre for h in held]), np.array([h[4].norm.max() for h in held])
    for row in asked:
        rows, ids, labels = (np.frombuffer(row[c], np.int64) for c in ("q_rows", "q_ids", "q_labels"))
        anchors, targets, wanted = Asked(_unpack(row["q_terms"], row["q_n"]), turn), Targets(row), np.frombuffer(row["wanted"], bool)
        shape = (*targets.low.shape, k)
        best = np.stack([np.full(shape, _LEAST), np.zeros(shape, np.int64), np.zeros(shape, np.int64)])  # scores, ids, rows
        least, most = anchors.around(centres, radii)
        for b in np.argsort(-np.where(wanted[:, None], most, -np.inf).max(axis=0), kind="stable"):
            live = np.flatnonzero(wanted & targets.reached(least[:, b : b + 1], most[:, b : b + 1])[:, 0])
            other_rows, other_ids, other_labels, terms, codes = held[b]
            if not len(live):
                continue
            near = targets.reached(*anchors.intervals(live, codes), live)
            near &= ((labels[live][:, None] == other_labels[None, :]) == same) & (rows[live][:, None] != other_rows[None, :])
            lines, columns = near.any(axis=1), np.flatnonzero(near.any(axis=0))
            if not len(columns):
                continue
            live, near = live[lines], near[lines][:, columns]
            _certain(anchors.terms[live], terms[columns])
            scores = products(anchors.terms[live], terms[columns])
            for j in range(shape[1]):
                at, found = _best(scores, near & (scores >= targets.low[live, j][:, None]) & (scores <= targets.high[live, j][:, None]), k)
                merged = np.concatenate([best[:, live, j], np.stack([found, other_ids[columns][at], other_rows[columns][at]])], axis=2)
                order = np.lexsort((merged[2], merged[1], ~merged[0]), axis=1)[:, :k]
                best[:, live, j] = np.take_along_axis(merged, order[None], axis=2)
                targets.low[live, j] = np.maximum(targets.low[live, j], best[0, live, j, -1])
        a, j, i = np.nonzero(best[0] > _LEAST)
        out.append([np.full(len(a), row["chunk"]), rows[a], ids[a], j, best[1][a, j, i], best[2][a, j, i], best[0][a, j, i]])
    return pa.table({n: pa.array(np.concatenate(x)) for n, x in zip(names, zip(*out, strict=True), strict=True)})


def _chosen(sheet: pa.Table, asked: pa.Table, turn: np.ndarray, same: bool, rest: bool) -> pa.Table:
    """Chunks and pages worth scoring: the FIRST of each anchor, or all others that may reach its ranges."""
    out: dict[str, list] = {"chunk": [], "page": [], "wanted": []}
    if sheet.num_rows:
        sheet = sheet.sort_by("page")
        pages, lowest, highest = (sheet.column(c).to_numpy() for c in ("page", "lowest", "highest"))
        centres, radii = np.stack([np.frombuffer(c) for c in sheet.column("centre").to_pylist()]), sheet.column("radius").to_numpy()
        for row in asked.to_pylist():
            labels = np.frombuffer(row["q_labels"], np.int64)[:, None]
            anchors, targets = Asked(_unpack(row["q_terms"], row["q_n"]), turn), Targets(row)
            least, most = anchors.around(centres, radii)
            fit_label = (lowest <= labels) & (labels <= highest) if same else (lowest != highest) | (lowest != labels)
            # where the best is likely: the highest bound, or a centre near the top of the ranges
            worth = most if same else -np.abs((least + most) / 2 - targets.high.max(axis=1)[:, None])
            order = np.argsort(-np.where(fit_label, worth, -np.inf), axis=1, kind="stable")[:, :FIRST]
            first = np.zeros(fit_label.shape, bool)
            np.put_along_axis(first, order, True, axis=1)
            wanted = fit_label & targets.reached(least, most) & (~first if rest else first)
            for p in np.flatnonzero(wanted.any(axis=0)):
                out["chunk"].append(row["chunk"])
                out["page"].append(pages[p])
                out["wanted"].append(wanted[:, p].tobytes())
    return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "page": pa.array(out["page"], pa.int64()), "wanted": pa.array(out["wanted"], pa.binary())})


def _summed(page: int, sheet: int, blocks: pa.Table, width: int) -> pa.Table:
    """A page's centre, the greatest distance from it, and its labels' range."""
    labels = np.concatenate([np.frombuffer(x, np.int64) for x in blocks.column("labels").to_pylist()])
    terms = np.concatenate([_unpack(t, n) for t, n in zip(blocks.column("terms").to_pylist(), blocks.column("n").to_pylist(), strict=True)]).astype(np.float64)
    centre = terms.mean(axis=0)
    radius = np.sqrt(((terms - centre) ** 2).sum(axis=1)).max()
    return pa.table({"sheet": [sheet], "page": [page], "centre": [centre.tobytes()], "radius": [float(radius)], "lowest": [int(labels.min())], "highest": [int(labels.max())]})


def _share(scores: np.ndarray, percent: int) -> np.ndarray:
    """floor(percent * score / 100) without leaving 64 bits."""
    return scores // 100 * percent + scores % 100 * percent // 100


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of each anchor and positive, exactly.

    Scores are integer inner products. An anchor's positives are the ``positives`` highest other rows of
    its label; the negatives of each are the ``negatives`` highest rows of other labels whose
    score is ``least`` to ``most`` percent of the positive's. Ties go to the smaller id.

    Vectors are ordered by label and nearest pivot, and packed into blocks with one-bit codes
    of what they have besides the block's centre. Chunks of anchors meet pages of blocks in groups
    of bounded size, as many as anchors and vectors ask for: FIRST pages of a sheet give each anchor its
    first scores, and then only pages and vectors are met whose bounds may reach what is found.

    Rows with a null id, label or vector, or a null or non-finite component, take no part.
    Vectors of different length are filled up with zeros. Rows that repeat an id are rows of
    their own, as anchors and as candidates. Anchors with fewer positives or negatives have what there is;
    an empty table gives no rows; other columns aren't read. Raises OverflowError if
    products don't fit 64 bits.
    """
    context = vectors.sparkSession.sparkContext
    table = write_table(fit(vectors).transform(bounded), "terms")
    width = max(table.agg(F.max(F.size("terms"))).first()[0] or 0, 1)
    some = table.orderBy(F.xxhash64("vec_id"), "vec_id", "terms").limit(PIVOTS).select("terms").toArrow()
    pivots = context.broadcast(_matrix(some.column("terms").combine_chunks(), width) if some.num_rows else np.zeros((1, width), np.int64))
    turn = context.broadcast(rotation(width))  # as large as a vector's width squared
    page_size, sheet_size = PAGE, SHEET

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                terms = _matrix(batch.column("terms"), width)
                _certain(terms, pivots.value)
                dots = products(terms, pivots.value)
                yield batch.append_column("cell", pa.array(dots.argmax(axis=1))).append_column("near", pa.array(dots.max(axis=1)))

    schema = "row bigint, vec_id bigint, label bigint, terms array<bigint>, cell bigint, near bigint"
    placed = write_table(table.mapInArrow(place, schema), "placed")
    page = F.floor(F.col("block") / page_size).cast("long")
    blocks = _packed(placed, BLOCK, turn, "blocks", width).withColumn("page", page).withColumn("sheet", F.floor(F.col("page") / sheet_size).cast("long"))
    q = {"n": "q_n", "rows": "q_rows", "ids": "q_ids", "labels": "q_labels", "terms": "q_terms"}
    anchors = _packed(placed.filter(is_anchor), CHUNK, turn, "anchors", width).select(F.col("block").alias("chunk"), *(F.col(c).alias(n) for c, n in q.items()))
    salts = max(1, -(-anchors.count() // TOGETHER))
    salted = anchors.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"))
    pages = write_table(
        blocks.select("sheet", "page", "n", "labels", "terms").groupBy("page", "sheet")
        .applyInArrow(lambda key, b: _summed(key[0].as_py(), key[1].as_py(), b, width), "sheet bigint, page bigint, centre binary, radius double, lowest bigint, highest bigint"),
        "pages",
    )
    sheets = pages.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    n_sheets = (pages.agg(F.max("sheet")).first()[0] or 0) + 1

    def choose(asked: DataFrame, same: bool, rest: bool) -> DataFrame:
        placed = asked.withColumn("sheet", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_sheets - 1).cast("long"))))
        run = lambda key, sheet, rows: _chosen(sheet, rows, turn.value, same, rest)
        return write_table(sheets.groupBy("sheet", "salt").cogroup(placed.groupBy("sheet", "salt")).applyInArrow(run, "chunk bigint, page bigint, wanted binary"), "chosen-pages")

    def meet(chosen: DataFrame, asked: DataFrame, k: int, same: bool) -> DataFrame:
        wanted = chosen.join(asked, "chunk")
        held = wanted.select(F.col("page").alias("at_page"), F.col("salt").alias("at_salt")).distinct()
        right = blocks.drop("sheet").join(held, F.col("page") == F.col("at_page"))
        run = lambda key, blocks_, rows: _met(blocks_.to_pylist(), rows.to_pylist(), turn.value, k, same)
        schema = "chunk bigint, query_row bigint, query_id bigint, target bigint, vec_id bigint, vec_row bigint, score bigint"
        return right.groupBy("at_page", "at_salt").cogroup(wanted.groupBy("page", "salt")).applyInArrow(run, schema)

    def updated(asked: DataFrame, found: DataFrame, change: Callable[[dict, pa.Table], tuple[np.ndarray, np.ndarray]], name: str) -> DataFrame:
        """``asked`` with new ranges, from the rows that were found for the chunk."""

        def run(key: tuple[pa.Scalar, ...], chunk: pa.Table, rows: pa.Table) -> pa.Table:
            made = [change(row, rows) for row in chunk.to_pylist()]
            return pa.table({"chunk": pa.array([key[0].as_py()] * len(made), pa.int64()), **{c: pa.array([m[i].astype(np.int64).tobytes() for m in made], pa.binary()) for i, c in enumerate(("low", "high"))}})

        made = asked.select("chunk", "q_n", "q_rows", "low", "high").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, "chunk bigint, low binary, high binary")
        return asked.drop("low", "high").join(write_table(made, name), "chunk")

    def raised(row: dict, found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        targets, at = Targets(row), {r: i for i, r in enumerate(np.frombuffer(row["q_rows"], np.int64).tolist())}
        lines = [at[r] for r in found.column("query_row").to_pylist()]
        np.maximum.at(targets.low, (lines, found.column("target").to_pylist()), found.column("score").to_numpy())
        return targets.low, targets.high

    def search(asked: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        best = Window.partitionBy("query_row", "target").orderBy(F.col("score").desc(), "vec_id", "vec_row")
        early = write_table(meet(choose(asked, same, False), asked, k, same), f"early-{name}")
        kth = early.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
        higher = updated(asked, kth.select("chunk", "query_row", "target", "score"), raised, f"raised-{name}")
        every = early.union(meet(choose(higher, same, True), higher, k, same))
        return write_table(every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), name)

    def whole(row: dict, found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.full((row["q_n"], 1), _LEAST), np.full((row["q_n"], 1), _MOST)

    def around_positives(row: dict, found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full((row["q_n"], positives), _MOST), np.full((row["q_n"], positives), _LEAST)
        at = {r: i for i, r in enumerate(np.frombuffer(row["q_rows"], np.int64).tolist())}
        where = [at[r] for r in found.column("query_row").to_pylist()], (found.column("rank").to_numpy() - 1).tolist()
        scores = found.column("score").to_numpy()
        low[where], high[where] = -_share(-scores, least), _share(scores, most)
        return low, high

    none = F.lit(b"")
    start = salted.withColumn("low", none).withColumn("high", none)
    no_rows = table.limit(0).select(F.lit(0).cast("long").alias("chunk"))
    found = search(updated(start, no_rows, whole, "whole-ranges"), positives, True, "positives")
    positive = found.select("chunk", "query_row", "query_id", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ranges = updated(start, found.select("chunk", "query_row", "rank", "score"), around_positives, "ranges")
    negative = search(ranges, negatives, False, "negatives").select("query_row", (F.col("target") + 1).alias("of"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = positive.select("query_row", F.col("query_id").alias("anchor_id"), F.col("rank").alias("of"), "positive_id", "positive_score")
    return negative.join(of, ["query_row", "of"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = r"""
WITH fit AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256::DOUBLE * x::DOUBLE)::BIGINT) AS t
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.t, c.t), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM fit a JOIN fit c ON a.r <> c.r WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id)::INT AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
