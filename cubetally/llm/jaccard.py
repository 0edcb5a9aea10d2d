"""N-gram Jaccard join by token-combination prefixes, and the groups of documents that it links.

A document is its set of word shingles (tokens here); two link when 100 * shared >= 75 * united.

Tokens are ordered rare class first, then by hash.  A token is frequent when the summed Misra-Gries summaries
of all map tasks give it FREQUENT occurrences or more (if more than MOST_FREQUENT tokens do, the bound rises);
the class decides the order only, so any class is right as long as all tasks use the same one.

* n tokens need t = ceil(0.75 n) shared ones, so if the least shared token of a pair is rare, it lies in the
  first n - t + 1 tokens of both sides: each rare token of that prefix is indexed alone.
* Otherwise all shared tokens are frequent.  The prefix is extended by g tokens, so that it holds g + 1 shared
  ones; with the frequent tokens in g hash classes, two of them meet in one class: 2-token combinations within
  each class are indexed, g growing with n so that their number stays near linear.  Documents with fewer than
  t frequent tokens need none.  g is fixed by size band; a document that may pair with one of the band below
  is indexed in both.

Verification goes in two rounds.  First, neighbours in each index bucket (by size and id) that meet often
are verified, which joins most copies.  Second, within buckets that still hold several components: in rare
buckets, pairs of different components that pass the size and the count filter (shared prefix tokens plus the
larger rest must reach the overlap needed) are verified, by 16-bit digests and then exactly; in combination
buckets, the documents outside a cluster's largest component are compared with the cluster in blocks.  No link
between different texts is lost: a pair is left out only if it is already connected or cannot be similar.
Pairs inside a component are not expanded.

Exact copies (same set by two 64-bit set hashes and size) are one class from the start.  Hot combination
buckets are salted by their estimated frequency.

Cases: null or empty texts have n_shingles 0 and link with nothing; a text of 1 to 4 words is one shingle;
a row with null doc_id keeps its counts, has a null component_id and links nothing; rows that repeat an id
are one node with the links of all its texts and one output row each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubetally.llm.arrowtext import mix64, releasing, SHINGLE, shingle_sets
from cubetally.llm.components import components
from cubetally.llm.shared import written

SIMILAR = (75, 100)
FREQUENT = 64
MOST_FREQUENT = 1 << 17
SUMMARY = 1 << 15
SALT_ROWS = 512
BANDS = ((1, 1), (48, 4), (192, 16), (768, 64), (3072, 256), (12288, 1024))  # from size, g
BROADCAST_IDS = 2_000_000
COPY_PARTS = 64  # parts of a class of equal texts
_ONE, _TWO = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def needed(n: int) -> int:
    return -(-SIMILAR[0] * n // SIMILAR[1])


class Summary:
    """Misra-Gries counts of tokens, SUMMARY at most, merged batch by batch."""

    def __init__(self):
        self.tokens, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, tokens: np.ndarray) -> None:
        new, n = np.unique(tokens, return_counts=True)
        every, at = np.unique(np.concatenate([self.tokens, new]), return_inverse=True)
        total = np.bincount(at, np.concatenate([self.counts, n]), len(every)).astype(np.int64)
        if len(every) > SUMMARY:
            total -= np.partition(total, len(every) - SUMMARY - 1)[len(every) - SUMMARY - 1]
            keep = total > 0
            every, total = every[keep], total[keep]
        self.tokens, self.counts = every, total


SCANNED = "kind int, a long, n long, fp1 long, fp2 long"


def scan(documents: DataFrame) -> DataFrame:
    """kind 0: (doc_id, set size, two set hashes) of each row; kind 1: (token, count) of the task's summary."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCANNED.split(", ")]
        summary, waiting, size = Summary(), [], 0
        for b in batches:
            n, one, two = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
            for r, s in shingle_sets(b.column(1)):
                n[r] = len(s)
                one[r] = mix64(s ^ _ONE).sum(dtype=np.uint64)
                two[r] = mix64(s + _TWO).sum(dtype=np.uint64)
                waiting.append(s)
                size += len(s)
                if size > 1 << 19:
                    summary.add(np.concatenate(waiting))
                    waiting, size = [], 0
            kind = pa.array(np.zeros(b.num_rows, np.int32))
            yield pa.RecordBatch.from_arrays([kind, b.column(0), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names)
        if waiting:
            summary.add(np.concatenate(waiting))
        keep = summary.counts > 1
        zero = np.zeros(int(keep.sum()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32) + 1), pa.array(summary.tokens[keep].view(np.int64)), pa.array(summary.counts[keep]), pa.array(zero), pa.array(zero)], names)

    return documents.select("doc_id", "text").mapInArrow(releasing(task), SCANNED)


class Frequent:
    """The frequent tokens (sorted) and their estimated counts; MOST_FREQUENT at most, so fit to broadcast."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]

    def counts_of(self, tokens: np.ndarray) -> np.ndarray:
        """Count of each token, 0 where it is rare."""
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.counts[at], 0)


def frequent_tokens(scanned: DataFrame) -> Frequent:
    sums = scanned.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    got = sums.orderBy(F.desc("n"), "a").limit(MOST_FREQUENT).toPandas()
    return Frequent(got["a"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64))


def bands_of(n: int) -> list[tuple[int, int]]:
    """(band, g) under which a document of n tokens is indexed: its own, and the one of its smaller partners."""
    own = max(i for i, (start, _) in enumerate(BANDS) if n >= start)
    out = [(own, BANDS[own][1])]
    if own and SIMILAR[0] * n < SIMILAR[1] * BANDS[own][0]:
        out.append((own - 1, BANDS[own - 1][1]))
    return out


def index_keys(tokens: np.ndarray, frequent: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rare keys, combination keys, estimated bucket size of each combination) of a sorted token set."""
    n = len(tokens)
    t = needed(n)
    counts = frequent.counts_of(tokens)
    often = counts > 0
    rare = tokens[~often][: n - t + 1]
    none = np.zeros(0, np.uint64)
    if int(often.sum()) < t:
        return rare, none, np.zeros(0, np.int64)
    f, c = tokens[often], counts[often]
    n_rare = n - len(f)
    keys, sizes = [], []
    for band, g in bands_of(n):
        take = max(0, n - t + g + 1 - n_rare)
        part, count = f[:take], c[:take]
        cls = (mix64(part) % np.uint64(g)).astype(np.int64)
        order = np.argsort(cls, kind="stable")  # within a class still by hash
        part, count, cls = part[order], count[order], cls[order]
        step = 1
        while True:  # pairs at distance ``step`` in the class order
            i = np.flatnonzero(cls[step:] == cls[:-step]) if step < len(cls) else np.zeros(0, np.int64)
            if not len(i):
                break
            keys.append(mix64(part[i] * np.uint64(3) + mix64(part[i + step]) + np.uint64(band)))
            sizes.append(np.minimum(count[i], count[i + step]))
            step += 1
    return rare, np.concatenate(keys) if keys else none, np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


ENTRIES = "key long, salt int, doc long, n int, prefix int"


def index(documents: DataFrame, frequent: Frequent) -> DataFrame:
    """Index entries of all documents; of copies within a task, the first one's.  prefix: rare tokens indexed, -1 for combinations."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ENTRIES.split(", ")]
        seen: set[tuple[int, int, int]] = set()  # one entry a document of this task
        for b in batches:
            ids, known = np.array(b.column(0).fill_null(0)), b.column(0).is_valid().to_numpy(zero_copy_only=False)
            keys, salts, docs, ns, prefixes, size = [], [], [], [], [], 0

            def flush() -> pa.RecordBatch:
                reps = np.array([len(k) for k in keys], np.int64)
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(salts).astype(np.int32)), pa.array(np.repeat(docs, reps)), pa.array(np.repeat(ns, reps).astype(np.int32)), pa.array(np.repeat(prefixes, reps).astype(np.int32))], names)

            for r, s in shingle_sets(b.column(1)):
                # sets of 1 or 2 tokens are similar to equal sets only
                if len(s) < 3 or not known[r]:
                    continue
                mark = (len(s), int(mix64(s ^ _ONE).sum(dtype=np.uint64)), int(mix64(s + _TWO).sum(dtype=np.uint64)))
                if mark in seen:
                    continue
                seen.add(mark)
                rare, combos, estimate = index_keys(s, shared.value)
                for k, salt, prefix in ((rare, np.zeros(len(rare), np.int64), len(rare)), (combos, None, -1)):
                    if len(k):
                        if salt is None:
                            own = mix64(ids[r : r + 1].view(np.uint64))
                            salt = (own % np.maximum(1, estimate // SALT_ROWS).astype(np.uint64)).astype(np.int64)
                        keys.append(k)
                        salts.append(salt)
                        docs.append(int(ids[r]))
                        ns.append(len(s))
                        prefixes.append(prefix)
                        size += len(k)
                if size > 1 << 18:
                    yield flush()
                    keys, salts, docs, ns, prefixes, size = [], [], [], [], [], 0
            if keys:
                yield flush()

    return documents.select("doc_id", "text").mapInArrow(releasing(task), ENTRIES)


MEMBERS = "key long, salt int, doc long, n int, prefix int, before long, before_n int, head boolean"


def chained(entries: DataFrame) -> DataFrame:
    """Entries of buckets with two members at least, each with the member before it (by size and id).

    ``entries`` must be dealt by (key, salt) and sorted; the state that a task keeps is one row.  Combination
    buckets keep their only member too, as other salts of the same key may have more.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            yield from out_of(held, t, False)
            held = t.slice(t.num_rows - 2, 2) if t.num_rows > 1 else (pa.concat_tables([held, t]).slice(max(0, held.num_rows - 1)) if held is not None else t)
        if held is not None:
            yield from out_of(held, None, True)

    # rows come in sorted order, so each row's neighbours are the rows beside it; the last row of a batch waits
    def out_of(held, t, last: bool) -> Iterator[pa.RecordBatch]:
        both = held if t is None else t if held is None else pa.concat_tables([held, t])
        c = {n: both[n].to_numpy() for n in ("key", "salt", "doc", "n", "prefix")}
        same = (c["key"][1:] == c["key"][:-1]) & (c["salt"][1:] == c["salt"][:-1])
        as_before, as_after = np.append(False, same), np.append(same, False)
        # a held table is (row already given, row that waits) or one waiting row
        first = 0 if held is None else held.num_rows - 1
        end = both.num_rows if last else both.num_rows - 1
        at = np.arange(first, max(first, end))
        at = at[(as_before[at] | as_after[at]) | (c["prefix"][at] < 0)]
        prev = np.maximum(at - 1, 0)
        linked = as_before[at]
        yield pa.RecordBatch.from_arrays([*[pa.array(c[n][at]) for n in ("key", "salt", "doc", "n", "prefix")], pa.array(c["doc"][prev], mask=~linked), pa.array(c["n"][prev], mask=~linked), pa.array(~linked)], [f.split()[0] for f in MEMBERS.split(", ")])

    return entries.mapInArrow(releasing(task), MEMBERS)


def wanted(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the rows whose id is in ``ids`` (want); broadcast up to BROADCAST_IDS ids, joined beyond."""
    few = ids.count() <= BROADCAST_IDS
    return documents.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("want"), "left_semi")


def token_sets(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, tokens) of the documents in ``ids``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, s in shingle_sets(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r, 1), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], ["doc", "tokens"])

    return wanted(documents, ids).mapInArrow(releasing(sets), "doc long, tokens array<long>")


def plausible(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` that 16-bit token digests do not rule out.

    Tokens of u whose digest occurs in v are at least the shared tokens, so this drops no link; it ships a
    quarter of the bytes of the exact sets.
    """
    ids = pairs.select(F.explode(F.array("u", "v")).alias("want")).distinct()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, s in shingle_sets(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r, 1), pa.array([(mix64(s) >> np.uint64(48)).astype(np.uint16).tobytes()], pa.binary())], ["doc", "digest"])

    found = wanted(documents, ids).mapInArrow(releasing(digests), "doc long, digest binary")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << 16, bool)
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for r in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[r].as_buffer(), np.uint16) for c in (2, 3))
                table[y] = True
                most = int(table[x].sum())
                table[y] = False
                keep[r] = most * SIMILAR[1] >= SIMILAR[0] * (len(x) + len(y) - most)
            yield b.select([0, 1]).filter(pa.array(keep))

    left = found.select(F.col("doc").alias("u"), F.col("digest").alias("a"))
    right = found.select(F.col("doc").alias("v"), F.col("digest").alias("b"))
    return pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(releasing(check), "u long, v long").distinct()


def verified(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` that link, by exact set comparison."""
    some = written(plausible(documents, pairs), "jaccard-plausible")
    found = token_sets(documents, some.select(F.explode(F.array("u", "v")).alias("want")).distinct())
    left = found.select(F.col("doc").alias("u"), F.col("tokens").alias("a"))
    right = found.select(F.col("doc").alias("v"), F.col("tokens").alias("b"))
    both = some.join(left, "u").join(right, "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared * SIMILAR[1] >= SIMILAR[0] * (F.size("a") + F.size("b") - shared)).select("u", "v").distinct()


def overlap_needed(n: F.Column, m: F.Column) -> F.Column:
    """Shared tokens that sets of n and m need: ceil(75 * (n + m) / 175)."""
    num, den = SIMILAR
    return F.floor(((n + m) * num + num + den - 1) / (num + den))


def sizes_fit(n: F.Column, m: F.Column) -> F.Column:
    return (n * SIMILAR[1] >= m * SIMILAR[0]) & (m * SIMILAR[1] >= n * SIMILAR[0])


def neighbours(members: DataFrame) -> DataFrame:
    """(u, v): members beside each other in many buckets, and heads of a key's salts; a first, incomplete choice."""
    beside = members.where("before is not null").select(F.col("before").alias("u"), F.col("doc").alias("v"), F.col("before_n").alias("un"), F.col("n").alias("vn"), "prefix")
    heads = members.where("prefix < 0 and head").repartition("key").sortWithinPartitions("key", "n", "doc").withColumn("salt", F.lit(0)).select("key", "salt", "doc", "n", "prefix")
    across = chained(heads).where("before is not null").select(F.col("before").alias("u"), F.col("doc").alias("v"), F.col("before_n").alias("un"), F.col("n").alias("vn"), "prefix")
    met = beside.unionByName(across).where(sizes_fit(F.col("un"), F.col("vn")) & (F.col("u") != F.col("v")))
    met = met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "prefix")
    met = met.groupBy("u", "v").agg(F.count("*").alias("times"), F.max("prefix").alias("prefix"))
    return met.where((F.col("prefix") < 0) | (F.col("times") * 3 >= F.col("prefix"))).select("u", "v")


def open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, doc, n, prefix, root) in buckets that still hold more than one component."""
    m = members.join(roots, members["doc"] == F.col("node"), "left").withColumn("root", F.coalesce("root", "doc")).select("key", "doc", "n", "prefix", "root")
    split = m.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("key").alias("open_key"))
    return m.join(split, F.col("key") == F.col("open_key"), "left_semi")


def remaining(still: DataFrame, tried: DataFrame) -> DataFrame:
    """(u, v): pairs of a rare bucket that are in different components and may still be similar."""
    rare = still.where("prefix >= 0")
    a, b = rare.alias("a"), rare.alias("b")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.doc") < F.col("b.doc")) & (F.col("a.root") != F.col("b.root")) & sizes_fit(F.col("a.n"), F.col("b.n"))
    met = a.join(b, on).groupBy(F.col("a.doc").alias("u"), F.col("b.doc").alias("v")).agg(F.count("*").alias("times"), F.max("a.n").alias("un"), F.max("b.n").alias("vn"), F.max("a.prefix").alias("up"), F.max("b.prefix").alias("vp"))
    # at most this many tokens are shared: those of both rare prefixes, and what lies behind the shorter reach
    most = F.col("times") + F.greatest(F.col("un") - F.col("up"), F.col("vn") - F.col("vp"))
    return met.where(most >= overlap_needed(F.col("un"), F.col("vn"))).select("u", "v").join(tried.select("u", "v"), ["u", "v"], "left_anti")


LEFT_BLOCK, RIGHT_BLOCK = 512, 2048


def straggler_links(documents: DataFrame, still: DataFrame) -> DataFrame:
    """(u, v): links across components within the open combination buckets.

    Documents that share such buckets, directly or through others, are a cluster.  Its documents outside the
    largest component meet all of the cluster in blocks of LEFT_BLOCK x RIGHT_BLOCK documents: a document
    travels once a block it meets, and only links leave a block, one for a document and component.
    """
    m = still.where("prefix < 0").select("key", "doc", "root").distinct()
    stars = m.groupBy("key").agg(F.min("doc").alias("v")).join(m, "key").select(F.col("doc").alias("u"), "v")
    clusters = components(stars).select(F.col("node").alias("doc"), F.col("root").alias("cluster"))
    docs = written(m.select("doc", "root").distinct().join(clusters, "doc"), "jaccard-clusters")
    main = docs.groupBy("cluster", "root").agg(F.count("*").alias("size")).groupBy("cluster").agg(F.max(F.struct("size", F.col("root").alias("main"))).alias("top"), F.sum("size").alias("all"))
    main = main.select("cluster", "top.main", "all", F.ceil((F.col("all") - F.col("top.size")) / LEFT_BLOCK).cast("int").alias("lefts"), F.ceil(F.col("all") / RIGHT_BLOCK).cast("int").alias("rights")).where("lefts > 0")
    placed = docs.join(main, "cluster")
    own = F.xxhash64("doc")
    left = placed.where("root <> main").select("cluster", "doc", "root", F.pmod(own, F.col("lefts")).cast("int").alias("l"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("r"), F.lit(0).alias("side"))
    right = placed.select("cluster", "doc", "root", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("l"), F.pmod(own, F.col("rights")).cast("int").alias("r"), F.lit(1).alias("side"))
    sets = token_sets(documents, docs.select(F.col("doc").alias("want")).distinct()).withColumnRenamed("doc", "d")
    met = left.unionByName(right)
    met = met.join(sets, met["doc"] == sets["d"]).select("cluster", "l", "r", "side", "doc", "root", "tokens")

    def block(t: pa.Table) -> pa.Table:
        side, doc, root = (t[c].to_numpy() for c in ("side", "doc", "root"))
        tokens = t["tokens"].combine_chunks()
        tokens = tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens
        size = np.asarray(tokens.value_lengths()).astype(np.int64)
        _, code = np.unique(tokens.flatten().to_numpy(), return_inverse=True)
        edge = np.append(0, np.cumsum(size))
        mark = np.zeros(int(code.max()) + 1, np.int32)
        found = []
        for i in np.flatnonzero(side == 0):
            own = code[edge[i] : edge[i + 1]]
            mark[own] = 1
            shared = np.add.reduceat(mark[code], edge[:-1])
            mark[own] = 0
            hit = np.flatnonzero((side == 1) & (root != root[i]) & (shared * SIMILAR[1] >= SIMILAR[0] * (size + size[i] - shared)))
            _, first = np.unique(root[hit], return_index=True)
            found += [(doc[i], doc[j]) for j in hit[first]]
        u, v = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
        return pa.table({"u": u, "v": v})

    return met.groupBy("cluster", "l", "r").applyInArrow(block, "u long, v long").distinct()


def copy_links(real: DataFrame) -> DataFrame:
    """(u, v): each id of a class of copies hangs on the least of its part of the class, that on the least of the class.

    A class is dealt over COPY_PARTS parts by id, so that a large one meets in no single task.
    """
    same = ["fp1", "fp2", "n_shingles"]
    dealt = real.select("doc_id", *same, F.pmod(F.xxhash64("doc_id"), F.lit(COPY_PARTS)).alias("part"))
    parts = dealt.groupBy(*same, "part").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    within = dealt.join(parts.where("first <> last"), [*same, "part"]).where("doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    least = parts.groupBy(*same).agg(F.min("first").alias("least"), F.count("*").alias("n")).where("n > 1")
    across = parts.join(least, same).where("first <> least").select(F.col("first").alias("u"), F.col("least").alias("v"))
    return within.distinct().unionByName(across)


def linked_groups(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``documents``."""
    spark = documents.sparkSession
    scanned = written(scan(documents), "jaccard-scan")
    rows = scanned.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), "fp1", "fp2")
    real = rows.where("doc_id is not null and n_shingles > 0")
    entries = index(documents, frequent_tokens(scanned))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "n", "doc")
    members = written(chained(dealt), "jaccard-members")
    # copies: every further id of a class is linked to its least one
    copies = written(copy_links(real), "jaccard-copies")
    first = written(neighbours(members), "jaccard-first")
    links = written(verified(documents, first).unionByName(copies), "jaccard-links")
    roots = written(components(links), "jaccard-roots")
    still = written(open_members(members, roots), "jaccard-open")
    second = written(remaining(still, first), "jaccard-second")
    more = verified(documents, second)
    if still.where("prefix < 0").limit(1).count():
        more = more.unionByName(straggler_links(documents, still))
    more = written(more, "jaccard-more")
    if more.limit(1).count():
        star = roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = written(components(star.unionByName(more)), "jaccard-all-roots")
    out = rows.join(roots, rows["doc_id"] == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose doc_id is the least of its group, columns unchanged.

    Rows are kept or dropped by id: rows that repeat a surviving id all stay.  Rows with a null id or without words stay.
    """
    gone = linked_groups(documents).where("component_id <> doc_id").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
    ELSE [] END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)
), e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l
), r(node, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.v, r.root FROM r JOIN e ON e.u = r.node
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id
GROUP BY d.doc_id, n.n
"""
