"""Near-duplicate documents by a MinHash LSH forest, links confirmed on full shingle sets.

Texts are lower-cased (A-Z only) and split at ASCII white space; a document's set holds its distinct shingles of `words`
words. Equal sets make one class, of which the smallest doc_id stands for all. Each class has one MinHash signature. A tree
of the forest is an order of the signature's numbers; classes that share the first `depth` numbers in a tree's order form a
region, sorted by the numbers that follow. Each class's candidates are the next ones in that order: in a small region all of it, in a
crowded one those with the longest common prefix, so the depth adapts to how crowded it is. Trees
start at different numbers: with 32 trees of depth 4, two sets of similarity 0.8 share a region in some tree with
probability 1 - 5e-8.

Candidates that by size alone can't be linked go. Links are then confirmed by intersecting full sets, in three rounds: the
best candidate of each class, then of each component found so far, then every candidate between different components. So
large groups don't confirm all their pairs. What a crowded region may have hidden is looked for last and exactly, on full
sets written as differences from what most of a crowd holds, by a prefix filter on the rarest differences (hidden_links). So
the only links that can be lost are those of two classes that share no region of any tree, 5e-8 of them at the bound.

Defined results: null text or text without words has the empty set, is linked with nothing and is its own component; fewer
words than a shingle needs are one shingle; rows with a null id are left out and repeated ids count once (see
common.keyed); an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbase.llm.common import batch_of, discard, forget_caches, gram_hashes, keyed, lasting, materialize, mixed, pairs, partitions_for, release_later, utf8, word_hashes
from lumenbase.llm.graph import components

SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary())])
SIGNED_DDL = "doc_id long, n_shingles long, k1 long, k2 long, sig binary"
NUMBERS = 128
MULT = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
SEEDS = np.random.default_rng(2014).integers(0, 1 << 32, NUMBERS, dtype=np.uint64).astype(np.uint32)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles."""
    h = word_hashes((text or b"").lower())
    return np.unique(gram_hashes(h, min(words, len(h)))) if len(h) else h


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The signature: of each of NUMBERS hash functions, the least value over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(NUMBERS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        y = (x[None, k : k + 2048] ^ SEEDS[:, None]) * MULT[0]
        y ^= y >> np.uint32(13)
        y *= MULT[1]
        y ^= y >> np.uint32(16)
        least = np.minimum(least, y.min(1))
    return least


def signed(docs: DataFrame, words: int) -> DataFrame:
    def sign(batches):
        forget_caches()
        for b in batches:
            rows = []
            for doc, text in pairs(b):
                s = shingle_set(text, words)
                if len(s):
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    rows.append((doc, len(s), *np.frombuffer(d, "<i8").tolist(), min_hashes(s).tobytes()))
                else:
                    rows.append((doc, 0, 0, 0, None))
            yield batch_of(SIGNED, [list(c) for c in zip(*rows, strict=True)] or [[]] * 5)

    return docs.mapInArrow(sign, SIGNED_DDL)


def planted(classes: DataFrame, trees: int, depth: int, deeper: int = 8) -> DataFrame:
    """region, tail, doc_id, n_shingles: each class once in each tree. tail: the following numbers, 16 bits of each."""
    schema = pa.schema([("region", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64())])
    step = NUMBERS // trees
    ahead = np.stack([(np.arange(depth + deeper) + t * step) % NUMBERS for t in range(trees)])

    def plant(batches):
        for b in batches:
            doc, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(len(doc), NUMBERS)
            for t in range(trees):
                own = sig[:, ahead[t]]
                region = gram_hashes(np.concatenate([own[:, :depth].T.astype(np.uint64), np.full((1, len(doc)), t, np.uint64)]), depth + 1)[0] if len(doc) else np.zeros(0, np.uint64)
                tail = (own[:, depth:] >> np.uint32(16)).astype(">u2").tobytes()
                tail = np.frombuffer(tail, ">u8").astype(np.uint64).reshape(-1, 2).view(np.int64)
                yield batch_of(schema, [region.view(np.int64), tail[:, 0], tail[:, 1], doc, n])

    return classes.select("doc_id", "n_shingles", "sig").mapInArrow(plant, "region long, t1 long, t2 long, doc_id long, n_shingles long")


def candidates(forest: DataFrame, share: int, reach: int, crowded: int, parts: int) -> DataFrame:
    """x < y, trees, crowd. trees: in how many trees the two were met as neighbours in a region's order whose sizes allow a
    similarity of `share` per cent. The first `reach` rows of a region meet the `reach` next ones, so a region of up to
    reach + 1 rows meets whole; further rows meet the `crowded` next ones, with which they share the longest prefixes.
    crowd: whether the two are next to each other, of whatever sizes, in a region of more than reach + 1 rows; so each such
    region is a chain of these pairs."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("crowd", pa.bool_())])

    def neighbours(batches):
        last = None
        for b in batches:
            region, doc, n = (b.column(k).to_numpy() for k in (0, 3, 4))
            place = np.arange(len(region))
            place = place - np.maximum.accumulate(np.where(np.r_[True, region[1:] != region[:-1]], place, 0))
            if last and len(region) and last[0][-1] == region[0]:  # the first region began in an earlier batch
                place[: np.argmax(np.r_[region != region[0], True])] += last[3][-1] + 1
            new, now = len(last[0]) if last else 0, (region, doc, n, place)
            region, doc, n, place = [np.concatenate(c) for c in zip(last, now, strict=True)] if last else now
            xs, ys = [], []
            for d in range(1, min(reach, len(doc) - 1) + 1):
                i = np.arange(max(0, new - d), len(doc) - d)  # rows before `new` were paired with each other already
                j = i + d
                ok = (region[i] == region[j]) & ((d <= crowded) | (place[i] < reach)) & (100 * np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j])) & (doc[i] != doc[j])
                xs.append(np.minimum(doc[i][ok], doc[j][ok]))
                ys.append(np.maximum(doc[i][ok], doc[j][ok]))
            met = sum(map(len, xs))
            over, first = (new + np.flatnonzero(c) for c in (place[new:] > reach, place[new:] == reach + 1))
            for j in [over, *[first - d for d in range(1, reach + 1)]]:  # a region's first rows once it proves crowded
                xs.append(np.minimum(doc[j - 1], doc[j]))
                ys.append(np.maximum(doc[j - 1], doc[j]))
            last = [c[-reach - 1 :] for c in (region, doc, n, place)]
            x, y = np.concatenate(xs), np.concatenate(ys)
            yield batch_of(schema, [x, y, np.arange(len(x)) >= met])

    ordered = forest.repartition(parts, "region").sortWithinPartitions("region", "t1", "t2", "doc_id")
    both = ordered.mapInArrow(neighbours, "x long, y long, crowd boolean")
    return both.groupBy("x", "y").agg(F.count_if(~F.col("crowd")).alias("trees"), F.max("crowd").alias("crowd"))


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """doc_id, shingles (sorted 64-bit numbers) of the wanted documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def sets(batches):
        for b in batches:
            yield batch_of(schema, [b.column(0), [shingle_set(t, words).tobytes() for _, t in pairs(b)]])

    return docs.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, shingles binary")


def measured(edges: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """x, y, linked: whether the pair's full sets are similar enough."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("linked", pa.bool_())])
    one, two = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "xy")
    both = edges.select("x", "y").join(one, "x").join(two, "y").select("x", "y", "sx", "sy")

    def measure(batches):
        for b in batches:
            linked = []
            for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * common >= share * (len(p) + len(q) - common))
            yield batch_of(schema, [b.column(0), b.column(1), linked])

    return both.mapInArrow(measure, "x long, y long, linked boolean")


def between(pairs_of: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs whose ends are in different components: x, y, trees, cx, cy."""
    if labels is None:
        return pairs_of.select("*", F.col("x").alias("cx"), F.col("y").alias("cy"))
    for c in "xy":
        pairs_of = pairs_of.join(labels.select(F.col("u").alias(c), F.col("v").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    return pairs_of.where("cx <> cy").select("x", "y", "trees", "cx", "cy")


def best_of_each(cross: DataFrame) -> DataFrame:
    """Of each component, its best pair to another one. Both ends are grouped in one pass and combine before the shuffle."""
    best = F.max(F.struct("trees", (-F.col("x")).alias("x"), (-F.col("y")).alias("y"))).alias("b")
    ends = cross.groupingSets([["cx"], ["cy"]], "cx", "cy").agg(best)
    mine = ends.groupBy(F.coalesce("cx", "cy").alias("c")).agg(F.max("b").alias("b"))
    return mine.select((-F.col("b.x")).alias("x"), (-F.col("b.y")).alias("y")).distinct()


def common_counts(one: list[np.ndarray], two: list[np.ndarray], columns: int = 2048, rare: int = 64) -> np.ndarray:
    """How many elements each set of the first list has in common with each of the second. Elements of few pairs are
    counted pair by pair, the others by products of 0/1 matrices, whose sums are exact below 2^24."""
    ends = [(np.concatenate(c), np.repeat(np.arange(len(c)), [len(x) for x in c])) for c in (one, two)]
    both = np.intersect1d(ends[0][0], ends[1][0])
    sides = []
    for h, row in ends:
        at = np.minimum(np.searchsorted(both, h), max(len(both) - 1, 0))
        held = both[at] == h if len(both) else np.zeros(len(h), bool)
        at, row = at[held], row[held]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], row[order], np.bincount(at, minlength=len(both))))
    (at1, row1, n1), (at2, row2, n2) = sides
    few = n1 * n2 <= rare
    start = np.cumsum(n2) - n2
    at, row = at1[few[at1]], row1[few[at1]]
    times = n2[at]
    partner = np.repeat(start[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    out = np.bincount(np.repeat(row, times) * len(two) + row2[partner], minlength=len(one) * len(two)).reshape(len(one), len(two)).astype(np.float32)
    column = np.cumsum(~few) - 1  # the others, numbered
    at1, row1, at2, row2 = column[at1[~few[at1]]], row1[~few[at1]], column[at2[~few[at2]]], row2[~few[at2]]
    for c in range(0, int((~few).sum()), columns):
        a, b = np.zeros((len(one), columns), np.float32), np.zeros((len(two), columns), np.float32)
        for m, k, row in ((a, at1, row1), (b, at2, row2)):
            lo, hi = np.searchsorted(k, [c, c + columns])
            m[row[lo:hi], k[lo:hi] - c] = 1
        out += a @ b.T
    return out.astype(np.int64)


CROWDED = "k long, n long, comp long, main long, m long, x long, delta binary"
POSTED = pa.schema([("k", pa.int64()), ("g", pa.int32()), ("n", pa.int64()), ("comp", pa.int64()), ("x", pa.int64()), ("kept", pa.binary())])
POSTED_DDL = "k long, g int, n long, comp long, x long, kept binary"
BUCKETS, GROUPED = 1 << 20, 4096


def with_crowd(nodes: DataFrame, told: DataFrame, salts: int = 32) -> DataFrame:
    """nodes with the columns of their crowd's one row; a crowd may hold most nodes, so its row is there `salts` times."""
    copies = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return nodes.withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(salts)).cast("int")).join(copies, ["k", "salt"]).drop("salt")


def bucket_of(k, e: np.ndarray) -> np.ndarray:
    """Where the elements e of crowd k are counted."""
    return (mixed(e ^ mixed(np.atleast_1d(np.asarray(k, np.int64)).view(np.uint64))) % np.uint64(BUCKETS)).astype(np.int64)


def tallied(batches, most: int = 1 << 21):
    """Sums of ones, before the shuffle: of (k, m, shingles) the numbers of sets of a crowd that hold a shingle."""
    schema = pa.schema([("k", pa.int64()), ("m", pa.int64()), ("s", pa.int64()), ("c", pa.int64())])
    held: dict[tuple, list] = {}
    size = 0

    def out():
        for (k, m), parts in held.items():
            s, c = np.unique(np.concatenate(parts), return_counts=True)
            yield batch_of(schema, [np.full(len(s), k), np.full(len(s), m), s.view(np.int64), c])
        held.clear()

    for b in batches:
        for k, m, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.setdefault((k, m), []).append(np.frombuffer(s, np.uint64))
            size += len(s) // 8
            if size > most:
                yield from out()
                size = 0
    yield from out()


def bucket_counts(rows: DataFrame, numbers, least: int) -> np.ndarray:
    """How often each bucket occurs, 0 where less often than `least`. numbers(batch) gives the buckets of a batch. A task
    sends each of its buckets once, and the driver gets BUCKETS numbers at most."""
    schema = pa.schema([("b", pa.int32()), ("c", pa.int64())])

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            total += np.bincount(numbers(b), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield batch_of(schema, [at.astype(np.int32), total[at]])

    got = rows.mapInArrow(count, "b int, c long").groupBy("b").agg(F.sum("c").alias("c")).where(F.col("c") >= least).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got.column("b").to_numpy()] = got.column("c").to_numpy()
    return out


def packed_nodes(posted: DataFrame, name: str, rows: int = 1024, shingles: int = 1 << 17) -> DataFrame:
    """k, g, part and an array of n, comp, x, kept: a group's sets in blocks of about so many rows and elements."""
    held = posted.groupBy("k", "g").agg(F.ceil(F.greatest(F.count(F.lit(1)) / rows, F.sum(F.length("kept")) / (8 * shingles))).alias("parts"))
    dealt = posted.join(held, ["k", "g"]).withColumn("part", F.pmod(F.xxhash64("n"), F.greatest("parts", F.lit(1))))
    return dealt.groupBy("k", "g", "part").agg(F.collect_list(F.struct("n", "comp", "x", "kept")).alias(name))


def hidden_links(chains: DataFrame, labels: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs u, v that are linked and join different components, enough to join all components that links within crowds
    do. Crowds are the connected components over `chains`; two classes that share a region of some tree without having been
    met there are in one crowd. Only crowds of several components are looked at.

    Sets of a crowd are much alike, so each is written as its difference `delta` from the crowd's centre, the shingles that
    more than half of its sets hold. With a = len(delta), n = len(set) and x = (100 + share) * a - (100 - share) * n, two sets
    are linked if and only if x1 + x2 <= 2 * (100 + share) * (what their deltas have in common). Hence, exactly:

    * let X be the least x of the crowd: a set with x + X <= 0 is linked with the set that has X, and one link does;
    * any other set must have t = (x + X) / 2 / (100 + share) elements of delta in common with a partner. Elements that no
      other delta has can't be common, so if fewer than t are left, the set has no link; else a partner holds one of the
      len - t + 1 rarest of those left (a prefix filter).

    Elements are dealt into a group for each GROUPED sets of the crowd. A set outside the crowd's main component goes to the
    groups of its prefix, and every set to those of its elements that are in some prefix, once each. Groups are compared in
    blocks of about 1024 sets, so that one that many share is many tasks' work, and pairs are never rows. How rare an element
    is and whether it is alone is read off BUCKETS counters; a collision can only make the filter wider."""
    per = 2 * (100 + share)
    crowds = components(chains.select(F.col("x").alias("u"), F.col("y").alias("v")))
    nodes = crowds.select(F.col("u").alias("n"), F.col("v").alias("k")).unionByName(crowds.select(F.col("v").alias("n"), F.col("v").alias("k")).distinct())
    nodes = nodes.join(labels.select(F.col("u").alias("n"), "v"), "n", "left").select("n", "k", F.coalesce("v", "n").alias("comp"))
    sizes = nodes.groupBy("k", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("k")
    several = sizes.agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("k", "main", "m")
    nodes = materialize(with_crowd(nodes, several).join(sets.select(F.col("doc_id").alias("n"), "shingles"), "n"), "nodes")
    held = nodes.select("k", "m", "shingles").mapInArrow(tallied, "k long, m long, s long, c long").groupBy("k", "m", "s").agg(F.sum("c").alias("c"))
    # a crowd of several components may have no shingle in common; its centre is then empty
    centre = held.groupBy("k").agg(F.collect_list(F.when(2 * F.col("c") > F.col("m"), F.col("s"))).alias("centre"))
    near = pa.schema([*[(c, pa.int64()) for c in ("k", "n", "comp", "main", "m", "x")], ("delta", pa.binary())])

    def differ(batches):
        for b in batches:
            x, deltas = [], []
            for s, c in zip(b.column(5).to_pylist(), b.column(6), strict=True):
                s = np.frombuffer(s, np.uint64)
                d = np.setxor1d(s, c.values.to_numpy().view(np.uint64), assume_unique=True)
                x.append((100 + share) * len(d) - (100 - share) * len(s))
                deltas.append(d.tobytes())
            yield batch_of(near, [*b.columns[:5], x, deltas])

    deltas = materialize(with_crowd(nodes, centre).select("k", "n", "comp", "main", "m", "shingles", "centre").mapInArrow(differ, CROWDED), "deltas")

    def numbers(b: pa.RecordBatch) -> np.ndarray:
        found = [bucket_of(k, np.frombuffer(d, np.uint64)) for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    spark = deltas.sparkSession
    counts = spark.sparkContext.broadcast(bucket_counts(deltas.select("k", "delta"), numbers, 2))
    least = deltas.groupBy("k").agg(F.min(F.struct("x", "n", "comp")).alias("least"))
    placed = with_crowd(deltas, least)
    direct = placed.where((F.col("x") + F.col("least.x") <= 0) & (F.col("comp") != F.col("least.comp"))).select(F.col("n").alias("u"), F.col("least.n").alias("v"))
    main = F.when(F.col("least.x") <= 0, F.col("least.comp")).otherwise(F.col("main"))
    placed = placed.select("k", "n", "comp", "m", "x", "delta", F.col("least.x").alias("low"), (main != F.col("comp")).alias("outside"))

    def left(k: int, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the elements that another delta may hold: their buckets, themselves and their counts."""
        at = bucket_of(k, d)
        c = counts.value[at]
        return at[c > 0], d[c > 0], c[c > 0]

    def posted(probes: bool, wanted=None, most: int = 4 << 20):
        """Of each set that may have a link, a row for each group of its prefix, or of its elements that are `wanted`."""

        def post(batches):
            for b in batches:
                rows, size = [], 0
                for k, n, comp, m, x, d, low, outside in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    t = -(-(x + low) // per)
                    if probes and (t <= 0 or not outside):
                        continue
                    at, d, c = left(k, np.frombuffer(d, np.uint64))
                    if len(d) < t:
                        continue
                    at = at[np.lexsort((d, c))[: len(d) - t + 1]] if probes else at[wanted.value[at]]
                    kept = d.tobytes()
                    rows += [(k, g, n, comp, x, kept) for g in np.unique(at % max(1, m // GROUPED)).tolist()]
                    size += len(kept) * len(at)
                    if size > most:
                        yield batch_of(POSTED, [list(c) for c in zip(*rows, strict=True)] or [[]] * 6)
                        rows, size = [], 0
                yield batch_of(POSTED, [list(c) for c in zip(*rows, strict=True)] or [[]] * 6)

        return post

    def prefixes(b: pa.RecordBatch) -> np.ndarray:
        """The buckets of the elements of prefixes."""
        out = [np.zeros(0, np.int64)]
        for k, _, _, _, x, d, low, outside in zip(*(c.to_pylist() for c in b.columns), strict=True):
            t = -(-(x + low) // per)
            if t > 0 and outside:
                at, d, c = left(k, np.frombuffer(d, np.uint64))
                out += [at[np.lexsort((d, c))[: len(d) - t + 1]]] if len(d) >= t else []
        return np.concatenate(out)

    asked = spark.sparkContext.broadcast(bucket_counts(placed, prefixes, 1) > 0)
    outside, inside = (materialize(packed_nodes(placed.mapInArrow(posted(*how), POSTED_DDL), name), name) for how, name in (((True,), "outside"), ((False, asked), "inside")))
    ids = [c.select("k", "g", F.col("part").alias(f"{n}_part")) for c, n in ((outside, "o"), (inside, "i"))]
    blocks = ids[0].join(ids[1], ["k", "g"])
    for c, n in ((outside, "o"), (inside, "i")):
        blocks = blocks.join(c.withColumnRenamed("part", f"{n}_part"), ["k", "g", f"{n}_part"])
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def arrays(rows: list) -> tuple:
        return *(np.array([r[c] for r in rows]) for c in ("n", "comp", "x")), [np.frombuffer(r["kept"], np.uint64) for r in rows]

    def compare(batches):
        for b in batches:
            for one, many in pairs(b):
                (o, oc, ox, osets), (m, mc, mx, msets) = arrays(one), arrays(many)
                i, j = np.nonzero((ox[:, None] + mx <= per * common_counts(osets, msets)) & (oc[:, None] != mc))
                _, first = np.unique(np.stack([oc[i], mc[j]]), axis=1, return_index=True)  # one link between two components
                yield batch_of(schema, [o[i[first]], m[j[first]]])

    met = blocks.select("outside", "inside").mapInArrow(compare, "u long, v long").distinct()
    links = materialize(met.unionByName(direct), "hidden")
    discard(crowds, nodes, deltas, outside, inside)
    return links


def near_duplicates(docs: DataFrame, words: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text", trees: int = 32, depth: int = 4, reach: int = 6, crowded: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept: one row per document. `share`: the
    least similarity, in per cent."""
    texts = utf8(keyed(docs, id_col, text_col))
    all_signed = lasting(signed(texts, words), "signatures")
    told = all_signed.select("doc_id", "n_shingles", "k1", "k2")
    classes = lasting(told.where("n_shingles > 0").groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = all_signed.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    near = materialize(candidates(planted(reps, trees, depth), share, reach, crowded, partitions_for(texts)), "candidates")
    met = near.where("trees > 0").select("x", "y", "trees")
    ends = near.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    sets = materialize(full_sets(texts, ends, words), "sets")
    labels, tested, old = None, None, []
    for step in ("best of each class", "best of each component", "all between components"):
        cross = between(met, labels)
        cross = cross if tested is None else cross.join(tested.select("x", "y"), ["x", "y"], "left_anti")
        pairs_now = cross.select("x", "y") if step.startswith("all") else best_of_each(cross)
        told_now = materialize(measured(pairs_now, sets, share), "measured")
        links = told_now.where("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
        old += [told_now] if labels is None else [told_now, labels]
        labels = components(links if labels is None else links.unionByName(labels))
        tested = told_now if tested is None else tested.unionByName(told_now)
    hidden = hidden_links(near.where("crowd"), labels, sets, share)
    old += [labels, hidden]
    labels = components(hidden.unionByName(labels))
    release_later(docs.sparkSession, labels.stored_at)
    discard(near, sets, *old)
    whole = classes.join(labels.select(F.col("u").alias("rep"), "v"), "rep", "left").select("n_shingles", "k1", "k2", F.coalesce("v", "rep").alias("component_id"))
    rows = told.join(whole, ["n_shingles", "k1", "k2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id") == F.col("component_id"))
