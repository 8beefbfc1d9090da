"""Vector code compression: product codes by Lloyd's rounds over cover trees.

Vectors become integers and are cut into equal parts; every part position has a
codebook. A block of vectors builds one cover tree for each part position, once:
children of a node are centres more than half its radius apart that cover its
points, and points lie in tree order, so that a subtree is a range and its sum a
difference of two cumulative sums. A round asks each tree with the codebook: if
the nearest entry to a node's centre is nearer than any other by more than twice
the node's radius, it is the nearest for the whole subtree; only other nodes are
opened, and leaves compare their points one by one. Distances are integers.

Blocks are stored once in the shared folder. The driver holds the codebooks,
whose size does not depend on the data.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.text import spread
from stationflow.session import materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK_ROWS = 8192  # vectors of one block of trees, at most
LEAF = 8  # points that are compared one by one
CHILDREN = 64  # centres chosen in a node; the points beyond them form one more child
LARGEST = 1 << 28  # of an integer component; squares of larger ones could overflow
TREE = ("lo", "hi", "centre", "reach", "child", "children")


def build(x: np.ndarray) -> tuple[np.ndarray, dict]:
    """(order, nodes) of the cover tree over the rows of ``x``. Node i holds the
    points order[lo:hi]; ``centre`` is a row number, ``reach`` the largest squared
    distance from it, ``child`` and ``children`` number the nodes below."""
    n = len(x)
    order = np.arange(n)
    reach = int(((x - x[0]) ** 2).sum(1).max())
    level = {"lo": np.array([0]), "hi": np.array([n]), "centre": np.array([0]), "reach": np.array([reach])}
    done, made = [], 1
    while True:
        size = level["hi"] - level["lo"]
        split = np.flatnonzero((size > LEAF) & (level["reach"] > 0))
        level["child"], level["children"] = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        done.append(level)
        if not len(split):
            return order, {k: np.concatenate([lv[k] for lv in done]) for k in TREE}
        place = spread(level["lo"][split], size[split])
        of = np.repeat(np.arange(len(split)), size[split])
        reach = level["reach"][split]
        turn, dist = np.full(len(place), CHILDREN), np.zeros(len(place), np.int64)
        centres = np.full((len(split), CHILDREN + 1), -1)
        open_ = np.arange(len(place))
        for k in range(CHILDREN + 1):
            head = np.flatnonzero(np.concatenate(([True], np.diff(of[open_]) > 0)))
            centres[of[open_][head], k] = order[place[open_[head]]]
            d = ((x[order[place[open_]]] - x[centres[of[open_], k]]) ** 2).sum(1)
            near = 4 * d <= reach[of[open_]] if k < CHILDREN else np.ones(len(open_), bool)
            turn[open_[near]], dist[open_[near]] = k, d[near]
            open_ = open_[~near]
            if not len(open_):
                break
        by = np.lexsort((turn, of))
        order[place] = order[place[by]]
        key = of[by] * (CHILDREN + 1) + turn[by]
        at = np.flatnonzero(np.concatenate(([True], np.diff(key) > 0)))
        parent, kth = np.divmod(key[at], CHILDREN + 1)
        per = np.bincount(parent, minlength=len(split))
        level["child"][split], level["children"][split] = made + np.cumsum(per) - per, per
        made += int(per.sum())
        ends = np.append(at[1:], len(key)) - 1
        level = {"lo": place[at], "hi": place[ends] + 1, "centre": centres[parent, kth], "reach": np.maximum.reduceat(dist[by], at)}


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row, ties to the lower index, and all squared distances."""
    d = ((x[:, None, :] - book[None]) ** 2).sum(2)
    return d.argmin(1), d


def assign(x: np.ndarray, tree: dict, book: np.ndarray):
    """(lo, hi, entry): ranges of ``x`` (rows in tree order) and the entry that is
    nearest to every row of each. ``centre`` of the tree is a row of ``x`` here."""
    out, front = [], np.zeros(1, np.int64)
    while len(front):
        below = []
        for at in range(0, len(front), 4096):
            f = front[at:at + 4096]
            best, d = _nearest(x[tree["centre"][f]], book)
            root, reach = np.sqrt(d.astype(float)), np.sqrt(tree["reach"][f].astype(float))
            first = root[np.arange(len(f)), best]
            root[np.arange(len(f)), best] = np.inf
            # the margin is far above the rounding of the roots
            sure = (root.min(1) * (1 - 1e-9) - 1e-6 > first + 2 * reach) | (tree["reach"][f] == 0)
            out.append((tree["lo"][f[sure]], tree["hi"][f[sure]], best[sure]))
            rest = f[~sure]
            leaf = rest[tree["children"][rest] == 0]
            rows = spread(tree["lo"][leaf], tree["hi"][leaf] - tree["lo"][leaf])
            if len(rows):
                out.append((rows, rows + 1, _nearest(x[rows], book)[0]))
            inner = rest[tree["children"][rest] > 0]
            below.append(spread(tree["child"][inner], tree["children"][inner]))
        front = np.concatenate(below)
    return tuple(np.concatenate(c) for c in zip(*out))


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of rows whose vector is there and holds numbers only."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return d.where(F.col("embedding").isNotNull() & F.forall("embedding", number))


def blocks(vectors: DataFrame, size: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each block of vectors: ids, labels and the packed trees."""
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                s = b.slice(at, rows)
                x = s.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS, size // PARTS)
                yield pa.RecordBatch.from_arrays([pa.array([s.column(c).to_pylist()], pa.list_(s.column(c).type)) for c in ("vec_id", "label")]
                                                 + [pa.array([_packed(integers(x))], pa.binary())], ["vec_ids", "labels", "trees"])

    return vectors.mapInArrow(run, f"vec_ids array<long>, labels array<{label}>, trees binary")


def integers(x: np.ndarray) -> np.ndarray:
    x = np.floor(x * SCALE)
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"a component is larger than {LARGEST // SCALE}: its squared distances would not fit into 64 bits")
    return x.astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    small = np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int32
    data = {}
    for p in range(PARTS):
        order, tree = build(x[:, p])
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        tree["centre"] = place[tree["centre"]]
        data |= {f"x{p}": x[order, p].astype(small), f"place{p}": place}
        data |= {f"{k}{p}": v if k == "reach" else v.astype(np.int32) for k, v in tree.items()}
    out = io.BytesIO()
    np.savez(out, **data)
    return out.getvalue()


def _trees(b: bytes):
    """(rows in tree order, place of each vector there, tree) of every part."""
    with np.load(io.BytesIO(b)) as z:
        for p in range(PARTS):
            yield z[f"x{p}"].astype(np.int64), z[f"place{p}"], {k: z[f"{k}{p}"].astype(np.int64) for k in TREE}


def lloyd(stored: DataFrame, book: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the mean of its parts, rounded down; an
    entry without parts stays. A task adds up its blocks first."""
    n, width = book.shape[1:]

    def run(batches):
        total = np.zeros((PARTS, n, width + 1), np.int64)  # sums of components, and counts
        for b in batches:
            for blob in b.column("trees").to_pylist():
                for p, (x, _, tree) in enumerate(_trees(blob)):
                    lo, hi, entry = assign(x, tree, book[p])
                    sums = np.concatenate((np.zeros((1, width + 1), np.int64), np.cumsum(np.c_[x, np.ones(len(x), np.int64)], 0)))
                    np.add.at(total[p], entry, sums[hi] - sums[lo])
        some = np.flatnonzero(total.any(2).reshape(-1)) if total.any() else np.zeros(0, np.int64)
        at = spread(some * (width + 1), np.full(len(some), width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], ["cell", "n"])

    total = np.zeros(PARTS * n * (width + 1), np.int64)
    cells = stored.select("trees").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in cells.collect():  # one row for each component of the codebooks, at most
        total[r["cell"]] = r["n"]
    total = total.reshape(PARTS, n, width + 1)
    count = total[:, :, -1:]
    return np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), book)


def encode(stored: DataFrame, book: np.ndarray) -> DataFrame:
    """vec_id, label, code (hex) and error of every stored vector."""
    label = stored.schema["labels"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for i, blob in enumerate(b.column("trees").to_pylist()):
                codes, error = [], 0
                for p, (x, place, tree) in enumerate(_trees(blob)):
                    lo, hi, entry = assign(x, tree, book[p])
                    code = np.empty(len(x), np.uint8)
                    code[spread(lo, hi - lo)] = np.repeat(entry, hi - lo)
                    error = error + ((x - book[p][code]) ** 2).sum(1)[place]
                    codes.append(code[place])
                text = np.stack(codes, 1).tobytes().hex()
                codes = [text[k:k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([b.column(c)[i:i + 1].flatten() for c in ("vec_ids", "labels")] + [pa.array(codes, pa.string()), pa.array(error)],
                                                 ["vec_id", "label", "code", "error"])

    return stored.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(table, codebooks): vec_id, label, code, error and label_error of every kept
    vector, and the final entries by part, entry and component.

    Rows whose vector is null or holds a null or non-finite component are
    dropped, and so are vectors of another length than that of the first vector
    (smallest vec_id, null last, then smallest vector); that length must be a
    multiple of 16. Components become floor(256 * x); codebooks begin with the
    parts of the first ``entries`` (at most 256) vectors in that order, fewer if
    there are fewer. Repeated rows and ids are coded like all others. label_error
    is the sum of errors of equal labels, null being one of them. An empty table
    gives an empty table. Other columns are not read. Components of over a million raise.
    """
    vectors = kept(vectors)
    top = vectors.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(1).collect()
    size = len(top[0]["embedding"]) if top else PARTS
    if size % PARTS or not size:
        raise ValueError(f"vectors of {size} components have no {PARTS} equal parts")
    vectors = vectors.where(F.size("embedding") == size)
    start = [r["embedding"] for r in vectors.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()]
    book = integers(np.array(start, float).reshape(-1, PARTS, size // PARTS)).transpose(1, 0, 2)
    stored = materialize(blocks(vectors, size, block_rows))
    for _ in range(rounds if start else 0):
        book = lloyd(stored, book)
    coded = materialize(encode(stored, book))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).select("vec_id", "label", "code", "error", "label_error"), book


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()
