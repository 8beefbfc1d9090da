"""N-gram Jaccard join with a token-group matrix.

A document's set are its distinct five-word shingles, as 64-bit hashes. Two sets
with a Jaccard similarity of t or more miss at most (1 - t) of either's size.

1. Sieve. Shards exchange a sample of their shingles (chosen by hash, the same
   in all documents; all shingles of small sets) with the number of documents
   that hold each. A set that misses too many of its sampled shingles
   everywhere has no partner.
2. Leaders. Each remaining set is compared with the most typical set (that with
   the most widely held shingles) among those that share one of its smallest
   common shingles. That joins large groups of near copies in linear time.
3. Token-group matrix. Similar sets (those that follow one leader, linked or
   not) are put into groups of a bounded size; a group stores the union of its
   members' sampled shingles. The overlap of a set with a group is bounded by the
   number of its rarest shingles in that union; only groups that may hold a
   partner are opened, and only if the set isn't connected to them yet. Of two
   components the smaller one asks. Within an opened group the comparison is
   exact.

The links found connect the same components as all links would.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm import shards as S
from stationflow.llm.components import components
from stationflow.llm.text import LOWER, U64, flat, grams, mix, words
from stationflow.session import materialize, work_path

SHINGLE = 5
PERCENT = 80
SAMPLE = 0.4  # share of the shingles of larger sets that are exchanged
SMALL = 80  # sets up to this size are judged by all their shingles
KEYS = 8  # smallest common shingles that lead to leaders
LEADERS = 2  # leaders that a set is compared with
GROUP = 512  # sets in a group of the matrix, on average at most
JUMPS = 3  # from leader to leader
QUERIES = 2000  # sets that ask one copy of a group

STAGE = ("doc_id long, n_shingles long, sig binary, tokens binary, score long, need int, "
         "sampled binary, probes binary, keys binary, digest binary")


def sets(shard: S.Shard, size: int = SHINGLE):
    """(tokens, owner, offsets): sorted distinct shingles of each document."""
    _, _, h, first = words(shard.data, shard.offsets, fold=LOWER)
    n = np.diff(first)
    own, tok = [], []
    all_grams = mix(grams(h, size))
    full = np.flatnonzero(n >= size)
    count = n[full] - size + 1
    from_ = first[full]
    ends = np.cumsum(count)
    at = np.arange(int(count.sum())) + np.repeat(from_ - (ends - count), count)
    own.append(np.repeat(full, count))
    tok.append(all_grams[at])
    for k in range(1, size):  # fewer words: the whole sequence
        d = np.flatnonzero(n == k)
        if len(d):
            own.append(d)
            tok.append(mix(grams(h, k)[first[d]] + U64(k)))
    own, tok = np.concatenate(own), np.concatenate(tok)
    order = np.lexsort((tok, own))
    own, tok = own[order], tok[order]
    keep = np.ones(len(tok), bool)
    keep[1:] = (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])
    own, tok = own[keep], tok[keep]
    return tok, own, np.searchsorted(own, np.arange(len(n) + 1))


def _missing(n, percent):
    """Shingles of a set of n that a partner may lack."""
    return n - -(-n * percent // 100)


def _sampled(tok, own, offsets, percent):
    """Which shingles are exchanged, and which of them judge their set."""
    n = np.diff(offsets)
    low = tok < U64(int(SAMPLE * 2**64))
    small, tiny = n <= SMALL * 100 // percent, n <= SMALL
    rank = np.arange(len(tok)) - offsets[own]
    # fewer sampled than a partner may lack: the smallest shingles as a prefix
    count = np.bincount(own[low], minlength=len(n))
    few = ~tiny & (count <= _missing(n, percent))
    prefix = few[own] & (rank <= _missing(n, percent)[own])
    send = low | small[own] | prefix
    judge = np.where(tiny[own], True, np.where(few[own], prefix, low))
    return send, judge, few


def _sieve(shard, percent):
    tok, own, offsets = sets(shard)
    send, _, _ = _sampled(tok, own, offsets, percent)
    send &= ~shard.copy[own]
    keys, n = np.unique(tok[send] & ~U64(0xFFFF), return_counts=True)
    return keys, np.minimum(n, 255).astype(np.uint8), 6


def _holders(keys, vals):
    """Number of documents that hold each key, 255 at most."""
    k, v = np.concatenate(keys), np.concatenate(vals).astype(np.int64)
    order = np.argsort(k, kind="stable")
    at = S.first_of(k[order])
    total = np.minimum(np.add.reduceat(v[order], at), 255).astype(np.uint8)
    uniq = k[order][at]
    return [total[np.searchsorted(uniq, x)] for x in keys]


def _stage(shard, percent, digests: bool) -> pa.Table:
    tok, own, offsets = sets(shard)
    n = np.diff(offsets)
    send, judge, few = _sampled(tok, own, offsets, percent)
    send &= ~shard.copy[own]
    judge &= send
    held = np.zeros(len(tok), np.uint8)
    _, back = np.unique(tok[send] & ~U64(0xFFFF), return_inverse=True)
    held[send] = shard.answer(1, np.uint8)[back]
    sums = [np.concatenate((np.zeros(1, U64), np.cumsum(mix(tok ^ U64(s))))) for s in (0, 0x5851F42D4C957F2D)]
    sig = np.stack([x[offsets[1:]] - x[offsets[:-1]] for x in sums], 1)
    judged = np.bincount(own[judge], minlength=len(n))
    alone = np.bincount(own[judge & (held < 2)], minlength=len(n))
    allowed = np.where(few, judged - 1, _missing(n, percent))
    rows = []
    for i in range(len(n)):
        if not n[i]:
            rows.append((None,) * 7)
            continue
        s = slice(offsets[i], offsets[i + 1])
        if shard.copy[i] or alone[i] > allowed[i] or judged[i] == alone[i]:
            rows.append((sig[i].tobytes(),) + (None,) * 6)
            continue
        t, h = tok[s], held[s]
        common = np.flatnonzero(judge[s] & (h >= 2))
        spare = int(allowed[i] - alone[i])
        probes = common[np.argsort(h[common], kind="stable")[:spare + 5]]
        rows.append((sig[i].tobytes(), t.tobytes(), int(h[common].astype(np.int64).sum() * 1000 // judged[i]), len(probes) - spare,
                     t[send[s] & (h >= 2)].tobytes(), t[probes].tobytes(), t[common[:KEYS]].tobytes()))
    cols = list(zip(*rows)) if rows else [()] * 7
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["sig", "tokens", "score", "need", "sampled", "probes", "keys"]
    digest = pa.array([shard.digest(i) if digests and n[i] else None for i in range(len(n))], pa.binary())
    return pa.table({"doc_id": shard.doc_id, "n_shingles": pa.array(n.astype(np.int64))} | {k: pa.array(c, t) for k, c, t in zip(names, cols, kinds)}
                    | {"digest": digest})


def _exploded(rows: DataFrame, blob: str, keep: list[str], name: str) -> DataFrame:
    """One row for each 8-byte number of a packed column."""
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + f", {name} long"

    def run(batches):
        for b in batches:
            data, off = flat(b.column(blob))
            again = pa.array(np.repeat(np.arange(b.num_rows), np.diff(off) // 8))
            yield pa.RecordBatch.from_arrays([b.column(c).take(again) for c in keep] + [pa.array(data.view(np.int64))], [*keep, name])

    return rows.select(*keep, blob).mapInArrow(run, schema)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _tokens(col) -> list[np.ndarray]:
    data, off = flat(col)
    data, off = data.view(U64), off // 8
    return [data[off[i]:off[i + 1]] for i in range(len(off) - 1)]


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Of rows (a, b, x, y) with packed sets x and y the linked (a, b)."""
    def run(batches):
        for b in batches:
            ok = [similar(x, y, percent) for x, y in zip(_tokens(b.column("x")), _tokens(b.column("y")))]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _leaders(cand: DataFrame) -> DataFrame:
    """(sid, leader, k): up to LEADERS leaders of each set, the best with k = 1."""
    key = _exploded(cand, "keys", ["sid", "score"], "key")
    best = key.groupBy("key").agg(F.max(F.struct("score", "sid"))["sid"].alias("leader"))
    votes = key.join(best, "key").where("sid <> leader").groupBy("sid", "leader").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("sid").orderBy(F.desc("votes"), "leader")
    return votes.withColumn("k", F.row_number().over(order)).where(F.col("k") <= LEADERS).select("sid", "leader", "k")


def _leader_links(cand: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    size = cand.select("sid", "tokens")
    left = leaders.join(size.hint("merge"), "sid").select(F.col("sid").alias("a"), "leader", F.col("tokens").alias("x"))
    lead = size.join(leaders.select(F.col("leader").alias("sid")).distinct(), "sid", "left_semi")
    both = left.join(lead.hint("merge"), left["leader"] == lead["sid"]).select("a", F.col("leader").alias("b"), "x", F.col("tokens").alias("y"))
    few = F.least(F.octet_length("x"), F.octet_length("y")) * 100 >= percent * F.greatest(F.octet_length("x"), F.octet_length("y"))
    return _pairs(both.where(few), percent)


def _open(members: pa.Table, asking: pa.Table, percent: int) -> pa.Table:
    """Links of the asking sets to members of the group, without those that the
    links before connect already."""
    out, up = [], {}

    def root(i):
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    sets_ = _tokens(members["tokens"])
    if sets_ and asking.num_rows:
        every, own = np.concatenate(sets_), np.repeat(np.arange(len(sets_)), [len(x) for x in sets_])
        order = np.argsort(every, kind="stable")
        every, own = every[order], own[order]
        n = np.array([len(x) for x in sets_])
        ids = members["sid"].to_pylist()
        known = [*zip(ids, members["root"].to_pylist()), *zip(asking["asker"].to_pylist(), asking["above"].to_pylist())]
        for i, r in known:
            up[root(i)] = root(r)
        for sid, x in zip(asking["asker"].to_pylist(), _tokens(asking["set"])):
            lo, hi = np.searchsorted(every, x), np.searchsorted(every, x, "right")
            count = hi - lo
            at = np.arange(int(count.sum())) + np.repeat(lo - (np.cumsum(count) - count), count)
            both = np.bincount(own[at], minlength=len(n))
            for k in np.flatnonzero(100 * both >= percent * (n + len(x) - both)):
                a, b = root(sid), root(ids[k])
                if a != b:
                    up[a] = b
                    out.append((sid, ids[k]))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _matrix_links(cand: DataFrame, leaders: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links between different components, through the token-group matrix.

    A set's family is the top of the leaders above it. Components of more than
    GROUP sets have groups of their own; all other sets of a family share its
    groups. A set of a large component asks the groups of larger ones only; any
    other set asks those of all large components, its own group, and the shared
    groups with a greater number, so every pair of sets is met once.
    """
    c = cand.select("sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    follow = leaders.where("k = 1").select("sid", "leader")
    top = follow.withColumnRenamed("leader", "family")
    for _ in range(JUMPS):
        up = follow.select(F.col("sid").alias("family"), F.col("leader").alias("above"))
        top = top.join(up, "family", "left").select("sid", F.coalesce("above", "family").alias("family"))
    c = c.join(top, "sid", "left")
    sizes = c.groupBy("root").agg(F.count("*").alias("size"))
    c = c.join(sizes, "root").withColumn("size", F.when(F.col("size") > GROUP, F.col("size")).otherwise(0))
    c = c.withColumn("family", F.when(F.col("size") > 0, F.xxhash64("root", F.lit("large"))).otherwise(F.xxhash64(F.coalesce("family", "sid"))))
    families = c.groupBy("family").agg(F.ceil(F.count("*") / GROUP).alias("blocks"))
    c = c.join(families, "family").withColumn("group", F.xxhash64("family", F.pmod(F.xxhash64("sid", F.lit("block")), F.col("blocks"))))
    # numbers only; packed sets join them by column where they are needed
    c = stored(c.withColumn("label", F.when(F.col("size") > 0, F.col("root")).otherwise(F.col("group")))
               .select("sid", "root", "size", "label", "group"), "groups")
    # planned as sorted joins at every size: these tables grow with the documents
    wide = c.hint("merge")
    tokens = cand.select("sid", "tokens")
    matrix = _exploded(cand.select("sid", "sampled").join(wide, "sid"), "sampled", ["group", "label", "size"], "token").groupBy("token", "group").agg(
        F.first("label").alias("label2"), F.first("size").alias("size2"))
    asks = _exploded(cand.select("sid", "need", "probes").join(wide, "sid"), "probes", ["sid", "label", "size", "need"], "token")
    larger = (F.col("size2") > F.col("size")) | ((F.col("size2") == F.col("size")) & (
        (F.col("label2") > F.col("label")) | ((F.col("size") == 0) & (F.col("label2") == F.col("label")))))
    hits = asks.join(matrix, "token").where(larger).groupBy("sid", "group").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    alone = c.groupBy("group").agg(F.count("*").alias("members"), F.first("size").alias("s")).where("members = 1 and s = 0")
    own = c.join(alone, "group").select("sid", "group")  # a group of one set has no other to ask
    opened = stored(hits.where("n >= need").select("sid", "group").join(own, ["sid", "group"], "left_anti"), "opened")
    copies = opened.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).alias("copies"))
    asking = (opened.join(copies, "group").withColumn("copy", F.pmod(F.xxhash64("sid"), F.col("copies")).cast("int"))
              .join(wide.select("sid", "root"), "sid").join(tokens.hint("merge"), "sid")
              .select(F.col("group").alias("asked"), F.col("copy").alias("part"), F.col("sid").alias("asker"),
                      F.col("root").alias("above"), F.col("tokens").alias("set")))
    members = (c.select("group", "sid", "root").join(copies, "group").join(tokens.hint("merge"), "sid")
               .withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")))).select("group", "copy", "sid", "root", "tokens"))
    return members.groupBy("group", "copy").cogroup(asking.groupBy("asked", "part")).applyInArrow(
        lambda m, a: _open(m, a, percent), "a long, b long")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read again: later plans read only the
    columns they need and know the size of the table. Hashes have no dictionary,
    and small row groups keep little in memory."""
    path = work_path(rows.sparkSession, f"jaccard-{name}")
    rows.write.option("parquet.enable.dictionary", "false").option("parquet.block.size", 16 << 20).parquet(path)
    return rows.sparkSession.read.parquet(path)


def _rooted(docs: DataFrame, percent: int, shard_bytes: int, digests: bool = False) -> DataFrame:
    """doc_id, n_shingles, digest (of the text, if ``digests`` and there are
    shingles) and root (null without shingles) for every row."""
    sh = S.Shards(docs, 1, shard_bytes)
    told = sh.answers()
    held = sh.ask(told, lambda s: _sieve(s, percent), _holders, 1)
    stage = sh.each(told.unionByName(held), lambda s: _stage(s, percent, digests), STAGE)
    stage = stored(stage.select("*", F.xxhash64("sig").alias("sid"), F.monotonically_increasing_id().alias("row")).drop("sig"), "sets")
    # all columns but doc_id and digest depend on the set alone, so any row stands for it
    have = stage.where("tokens is not null")
    first = have.groupBy("sid").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = stored(have.select("sid", "row").join(first, "sid").where("row <> first").select("row"), "same")
    cand = have.join(same, "row", "left_anti").select("sid", "score", "need", "tokens", "sampled", "probes", "keys")
    leaders = materialize(_leaders(cand))
    links = materialize(_leader_links(cand, leaders, percent))
    more = materialize(_matrix_links(cand, leaders, components(links), percent))
    roots = components(links.union(more))
    rows = stage.select("doc_id", "n_shingles", "digest", F.when(F.col("n_shingles") > 0, F.col("sid")).alias("sid"))
    rows = rows.join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    return rows.select("doc_id", "n_shingles", "digest", F.coalesce("root", "sid").alias("root"))


def jaccard_join(docs: DataFrame, percent: int = PERCENT, shard_bytes: int = S.SHARD_BYTES) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead
    to, itself included) for every row.

    Words are runs of other than blank characters, A-Z lower-cased. A text of one
    to four words is one shingle; null, empty and blank texts have none, link
    with nothing and are their own component. Two documents link when 100 *
    intersection >= percent * union. Only doc_id and text are read. Repeated rows
    are one set; a null doc_id counts as larger than any other, and a component
    of such rows only has a null id. An empty table gives an empty result. Sets
    are held to be equal by 128-bit sums of their hashes.
    """
    rows = _rooted(docs, percent, shard_bytes)
    least = rows.groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least.where("root is not null"), "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def without_near_copies(docs: DataFrame, percent: int = PERCENT, shard_bytes: int = S.SHARD_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, but one row of each component
    only: that with the smallest doc_id (null last) and then the smallest digest
    of its text, whether ids are null, repeated or not. Of rows alike in id and
    text one stays. Rows without shingles are components of their own."""
    rows = _rooted(docs, percent, shard_bytes, True).where("root is not null")
    rows = rows.select("root", F.struct(F.coalesce("doc_id", F.lit(S.NO_ID)).alias("no"), F.col("digest").alias("of")).alias("row"))
    first = rows.groupBy("root").agg(F.min("row").alias("first"))
    gone = rows.join(first, "root").where("row <> first").select("row.*").distinct()
    no = F.coalesce(F.col("doc_id").cast("long"), F.lit(S.NO_ID)).alias("no")
    of = F.unhex(F.sha2(F.col("text").cast("string").cast("binary"), 256)).alias("of")
    twins = docs.select(no, of).groupBy("no", "of").agg(F.count("*").alias("n")).where("n > 1")
    # narrow verdicts on ids and digests; only twins' texts meet to leave one of them
    told = gone.select("no", "of", F.lit(True).alias("out")).unionByName(twins.select("no", "of", F.lit(False).alias("out")))
    told = stored(told.groupBy("no", "of").agg(F.max("out").alias("out")), "verdicts")
    names = [f"`{c}`" for c in docs.columns]
    marked = docs.select(F.struct(*names).alias("doc"), no, of)
    told = told.select(F.col("no").alias("no2"), F.col("of").alias("of2"), "out").hint("merge")  # it grows with the documents
    marked = marked.join(told, (F.col("no") == F.col("no2")) & F.col("of").eqNullSafe(F.col("of2")), "left")
    return marked.where("out is null").select("doc.*").unionByName(
        marked.where("not out").select("doc.*").dropDuplicates(["doc_id", "text"]))
