"""N-gram Jaccard join with set-relation skipping, and the groups its links form.

A document's set holds the hashes of its shingles; documents with equal sets are one set from the start. Two sets link when
the share of common shingles reaches the threshold. Work is skipped twice:

* Index: the first part of each set (by hash) goes into posting lists. Long enough parts of two linked sets share several
  entries, so a set need only look at its rarest entries up to a position; later entries are skipped. A list is cut into
  overlapping blocks of similar set size, and a block that holds one set is skipped as a whole. A block names one of its
  sets as leader, and every set of the block is compared with the leader only: all sets that could link meet at a leader.
* Answers: sets that link with the leader have their answer. Only the others are compared with the rest of the star, in
  blocks, by sketches first: a bit for each range of the hash tells whether an odd number of a set's entries lie there, and
  two sets differ in as many entries, at least, as in bits. Sets whose sketch rules out every link need no more; of the rest
  the comparison with the leader yields what a set lacks and adds, and the overlap of any two follows from these
  differences: |leader| - gone(x) - gone(y) + |differences in common|.

Links that only repeat what is known of a group are never made; no link between different groups is lost. Entries of
posting lists travel in blocks with five bytes a hash; a wrong match of those costs one comparison and changes no result.
Whole sets are made again from the texts that a bitmap of fixed size lets through; one too many costs its way only.
Sets are told apart by 64-bit hashes (expected number of confused pairs among N sets: N * N / 2 ** 65).

Defined results: a null or blank text has an empty set and links with nothing; a text of fewer words than a shingle is one
shingle; a null id counts as the smallest and a group that holds it has a null component; repeated rows are equal sets;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.llm.common import LOWER, U64, by_bucket, chunks, keyed, mix, partitions, piece_hash, rows_keyed, text_buffer, window_hash, word_bounds, written

SHINGLE, PERCENT = 5, 75
#: Sets of a star that a block of its unlinked sets is compared with at once.
ROWS, COLUMNS = 256, 2048
#: Slots of the bitmap of wanted documents; a sketch has four bits or more an entry of the leader, and so many at most.
SLOTS, SKETCH = 1 << 26, 1 << 17
KEY_BITS = 40
POSTINGS = "bucket int, sids binary, sizes binary, counts binary, keys binary"
CHOICES = "shard int, sids binary, sizes binary, counts binary, freq binary, token binary, leads binary"


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Entries that a set of n has in common with any set it links with, at least."""
    return (n * percent + 99) // 100


def spare(n: np.ndarray, percent: int) -> np.ndarray:
    """How many entries of their first parts linked sets share, at least, as far as the size of one tells."""
    return np.minimum(1 + n // 20, least_overlap(n, percent))


def part_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - least_overlap(n, percent) + spare(n, percent)


def shingle_sets(column, shingle: int) -> list[np.ndarray]:
    """The ascending hashes of each text's shingles."""
    buf, off = text_buffer(column)
    buf = LOWER[buf]
    starts, ends, words = word_bounds(buf, off)
    h = piece_hash(buf, starts, ends)
    windows = window_hash(h, shingle)
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(windows[a: b - shingle + 1]))
        elif b > a:
            out.append(mix(window_hash(h[a:b], b - a) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_id(s: np.ndarray) -> int:
    return int(mix(mix(s).sum(keepdims=True, dtype=U64) + U64(len(s)))[0].astype(np.int64))


def classes(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, kid, tv, n_shingles, sid (null: empty set)."""

    def measure(batches):
        for t in chunks(batches):
            sets = shingle_sets(t.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("doc_id", "kid", "tv")), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "kid", "tv", "n_shingles", "sid"])

    return docs.mapInArrow(measure, "doc_id long, kid long, tv long, n_shingles long, sid long")


def postings(docs: DataFrame, shingle: int, percent: int, n: int) -> DataFrame:
    """The first parts of all sets, one row for each bucket and chunk of documents."""

    def emit(batches):
        for t in chunks(batches):
            sets = {set_id(s): s for s in shingle_sets(t.column("text"), shingle) if len(s)}
            if not sets:
                continue
            sids, sizes = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()])
            take = part_size(sizes, percent)
            key = np.concatenate([s[:k] for s, k in zip(sets.values(), take.tolist())])
            owner = np.repeat(np.arange(len(sids)), take)
            order, bounds = by_bucket((key % U64(n)).astype(np.int64), n)
            rows = []
            for b in range(n):
                i = order[bounds[b]: bounds[b + 1]]
                who, counts = np.unique(owner[i], return_counts=True)
                low = np.ascontiguousarray(key[i] >> U64(8)).view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
                rows.append({"bucket": b, "sids": sids[who].tobytes(), "sizes": sizes[who].astype(np.uint32).tobytes(), "counts": counts.astype(np.uint32).tobytes(), "keys": low.tobytes()})
            yield from pa.Table.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("sids", "sizes", "counts", "keys"))])).to_batches(max_chunksize=64)

    return docs.select("text").mapInArrow(emit, POSTINGS)


def joined(t: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(column).to_pylist()), kind)


def size_block(n: np.ndarray, percent: int) -> np.ndarray:
    """Linked sets lie in the same or in neighbouring classes of size."""
    return np.floor(np.log(n) / np.log(100 / percent) + 1e-9).astype(np.int64)


def read_lists(found: DataFrame, percent: int, n: int) -> DataFrame:
    """For each entry that several sets share: how many, and the leaders of the two size blocks the set is in (0: none)."""

    def reduce(t: pa.Table) -> pa.Table:
        sids, sizes, counts = joined(t, "sids", np.int64), joined(t, "sizes", np.uint32).astype(np.int64), joined(t, "counts", np.uint32)
        low = joined(t, "keys", np.uint8).reshape(-1, KEY_BITS // 8)
        key = np.zeros((len(low), 8), np.uint8)
        key[:, : KEY_BITS // 8] = low
        key = key.view(U64)[:, 0]
        owner = np.repeat(np.arange(len(sids)), counts)
        new = np.zeros(len(sids), bool)
        new[np.unique(sids, return_index=True)[1]] = True  # equal sets of several chunks
        key, owner = key[new[owner]], owner[new[owner]]
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        freq = np.diff(np.append(start, len(key)))
        freq_of = np.repeat(freq, freq)
        shared = freq_of > 1
        group = np.repeat(np.arange(len(freq)), freq)[shared]
        key, owner, freq_of = key[shared], owner[shared], freq_of[shared]
        block = size_block(np.maximum(sizes, 1), percent)
        rank = np.empty(len(sids), np.int64)
        rank[np.argsort(mix(sids.view(U64)), kind="stable")] = np.arange(len(sids))
        leads = np.zeros((len(key), 2), np.int64)
        g2, b2, o2 = np.tile(group, 2), np.concatenate((block[owner], block[owner] + 1)), np.tile(owner, 2)
        order = np.lexsort((rank[o2], b2, g2))
        g2, b2, o2 = g2[order], b2[order], o2[order]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(g2)), bool), (g2[1:] != g2[:-1]) | (b2[1:] != b2[:-1]))))
        size = np.diff(np.append(start, len(g2)))
        lead = np.where(size > 1, sids[o2[start]] if len(start) else np.zeros(0, np.int64), 0)
        flat = np.empty(len(g2), np.int64)
        flat[order] = np.repeat(lead, size)
        leads[:, 0], leads[:, 1] = flat[: len(key)], flat[len(key):]
        token = key | U64(int(t.column("bucket")[0].as_py()) << KEY_BITS)
        by_owner = np.argsort(owner, kind="stable")
        key, owner, freq_of, leads, token = key[by_owner], owner[by_owner], freq_of[by_owner], leads[by_owner], token[by_owner]
        order, bounds = by_bucket(((sids[owner].view(U64) >> U64(32)) % U64(n)).astype(np.int64), n)
        rows = []
        for s in range(n):
            i = order[bounds[s]: bounds[s + 1]]
            if len(i):
                who, counts = np.unique(owner[i], return_counts=True)
                rows.append({"shard": s, "sids": sids[who].tobytes(), "sizes": sizes[who].astype(np.uint32).tobytes(), "counts": counts.astype(np.uint32).tobytes(),
                             "freq": freq_of[i].astype(np.uint32).tobytes(), "token": token[i].tobytes(), "leads": leads[i].tobytes()})
        return pa.Table.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("sids", "sizes", "counts", "freq", "token", "leads"))]))

    return found.groupBy("bucket").applyInArrow(reduce, CHOICES)


def choose_leaders(found: DataFrame, percent: int) -> DataFrame:
    """sid, lead: the different leaders among each set's rarest entries; entries after the last useful position are skipped."""

    def choose(t: pa.Table) -> pa.Table:
        sids, counts = joined(t, "sids", np.int64), joined(t, "counts", np.uint32)
        n = np.repeat(joined(t, "sizes", np.uint32).astype(np.int64), counts)
        sid, freq, token = np.repeat(sids, counts), joined(t, "freq", np.uint32), joined(t, "token", U64)
        leads = joined(t, "leads", np.int64).reshape(-1, 2)
        order = np.lexsort((token, freq, sid))
        sid, n, leads = sid[order], n[order], leads[order]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(sid)), bool), sid[1:] != sid[:-1])))
        count = np.diff(np.append(start, len(sid)))
        place = np.arange(len(sid)) - np.repeat(start, count)
        part = part_size(n, percent)
        alone = part - np.repeat(count, count)  # entries that no other set has are rarer still
        useful = alone + place <= part - spare(least_overlap(n, percent), percent)
        pairs = np.stack([np.repeat(sid[useful], 2), leads[useful].ravel()], axis=1)
        pairs = np.unique(pairs[(pairs[:, 1] != 0) & (pairs[:, 0] != pairs[:, 1])], axis=0)
        return pa.table({"sid": pairs[:, 0], "lead": pairs[:, 1]})

    return found.groupBy("shard").applyInArrow(choose, "sid long, lead long")


def wanted(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with a bit for every kid and tv."""
    out, part = np.zeros(SLOTS // 8, np.uint8), 32768
    at = slot()
    for r in keys.select(at.alias("slot")).groupBy(F.floor(F.col("slot") / part).alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % part).alias("bits")).collect():
        out[r.part * part // 8: (r.part + 1) * part // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def slot():
    return F.pmod(F.xxhash64("kid", "tv"), F.lit(SLOTS))


def members(docs: DataFrame, known: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """sid, members: the sets of the pairs, and of a few other documents, made from the text of one document each."""
    needed = pairs.select("sid").unionByName(pairs.select(F.col("lead").alias("sid"))).distinct()
    chosen = known.where("sid is not null").groupBy("sid").agg(F.min(F.struct("kid", "tv")).alias("k")).join(needed, "sid").select("k.kid", "k.tv")
    shipped = docs.sparkSession.sparkContext.broadcast(wanted(chosen))

    def emit(batches):
        bits = shipped.value

        def passed():
            for b in batches:
                at = b.column("slot").to_numpy()
                yield b.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

        for t in chunks(passed()):
            sets = list({set_id(s): s for s in shingle_sets(t.column("text"), shingle) if len(s)}.items())
            for at in range(0, len(sets), 500):
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sets[at: at + 500]], pa.int64()), pa.array([s.tobytes() for _, s in sets[at: at + 500]], pa.binary())], names=["sid", "members"])

    return docs.select(slot().alias("slot"), "text").mapInArrow(emit, "sid long, members binary").groupBy("sid").agg(F.first("members").alias("members"))


def with_leaders(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = pairs.select("lead", "sid").join(sets, "sid").join(sets.select(F.col("sid").alias("lead"), F.col("members").alias("lead_members")), "lead")
    return both.select("lead", "sid", "members", "lead_members")


def sketch(s: np.ndarray, n_lead: int) -> bytes:
    """Whether the number of entries is odd, for each of equal ranges of the hash; as many ranges in every sketch of a star."""
    bits = min(max(6, (4 * n_lead - 1).bit_length()), SKETCH.bit_length() - 1)
    return np.packbits(np.bincount((s >> U64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).tobytes()


def against_leaders(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """lead, sid, n, linked, sketch: each set against its leader."""

    def compare(batches):
        for b in batches:
            n, linked, sketches = [], [], []
            for x, y in zip(b.column("members"), b.column("lead_members")):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                n.append(len(x)), linked.append(100 * common >= percent * (len(x) + len(y) - common)), sketches.append(sketch(x, len(y)))
            yield pa.RecordBatch.from_arrays([b.column("lead"), b.column("sid"), pa.array(n, pa.int64()), pa.array(linked, pa.bool_()), pa.array(sketches, pa.binary())],
                                             names=["lead", "sid", "n", "linked", "sketch"])

    return with_leaders(pairs, sets).mapInArrow(compare, "lead long, sid long, n long, linked boolean, sketch binary")


def differences(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """lead, sid, n, n_lead, gone, diff, linked: each set against its leader; diff holds what it lacks and adds."""

    def compare(batches):
        for b in batches:
            n, n_lead, gone, diff, linked = [], [], [], [], []
            for x, y in zip(b.column("members"), b.column("lead_members")):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                d = np.setxor1d(x, y, assume_unique=True)
                missing = (len(y) - len(x) + len(d)) // 2
                common = len(y) - missing
                n.append(len(x)), n_lead.append(len(y)), gone.append(missing), diff.append(d.tobytes())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("lead"), b.column("sid"), pa.array(n, pa.int64()), pa.array(n_lead, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(diff, pa.binary()), pa.array(linked, pa.bool_())], names=["lead", "sid", "n", "n_lead", "gone", "diff", "linked"])

    return with_leaders(pairs, sets).mapInArrow(compare, "lead long, sid long, n long, n_lead long, gone long, diff binary, linked boolean")


def common_counts(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all rows with all columns: frequent values by matrix products, rare ones by pairs."""
    out = np.zeros((len(rows), len(columns)), np.float32)
    values = np.concatenate([*rows, *columns])
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    c = np.repeat(np.arange(len(columns)), [len(x) for x in columns])
    _, code = np.unique(values, return_inverse=True)
    rc, cc = code[: len(r)], code[len(r):]
    m = int(code.max()) + 1 if len(code) else 0
    in_rows, in_columns = np.bincount(rc, minlength=m), np.bincount(cc, minlength=m)
    both = (in_rows > 0) & (in_columns > 0)
    rare = both & (in_rows * in_columns <= 64)
    frequent = np.flatnonzero(both & ~rare)
    for at in range(0, len(frequent), 2048):
        slot = np.full(m, -1)
        slot[frequent[at: at + 2048]] = np.arange(len(frequent[at: at + 2048]))
        a, b = np.zeros((len(rows), 2048), np.float32), np.zeros((len(columns), 2048), np.float32)
        i, j = slot[rc] >= 0, slot[cc] >= 0
        a[r[i], slot[rc[i]]] = 1
        b[c[j], slot[cc[j]]] = 1
        out += a @ b.T
    i, j = np.flatnonzero(rare[rc]), np.flatnonzero(rare[cc])
    j = j[np.argsort(cc[j], kind="stable")]
    lo = np.searchsorted(cc[j], rc[i])
    times = in_columns[rc[i]]
    left = np.repeat(r[i], times)
    right = c[j[np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)]]
    np.add.at(out, (left, right), 1)
    return out.astype(np.int64)


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest reachable node of each of n nodes over the given edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def star_blocks(table: DataFrame):
    """The sets of each star as rows (those that don't link with the leader) and columns (all), grouped by blocks."""
    star = table.groupBy("lead").agg(F.count("*").alias("k"), F.sum((~F.col("linked")).cast("long")).alias("s")).where("s > 0 and k > 1")
    star = star.select("lead", F.ceil(F.col("s") / ROWS).alias("nb"), F.ceil(F.col("k") / COLUMNS).alias("nc"))
    in_star = table.join(star, "lead")
    b, c = F.pmod(F.xxhash64("sid"), "nb"), F.pmod(F.xxhash64(F.lit(1), "sid"), "nc")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = in_star.where("not linked").select(*table.columns, F.lit(True).alias("is_row"), b.alias("b"), every("nc").alias("c"))
    columns = in_star.select(*table.columns, F.lit(False).alias("is_row"), every("nb").alias("b"), c.alias("c"))
    # the blocks of a star are dealt out one by one; else they stay where the join by leader has put them
    return rows.unionByName(columns).repartition("lead", "b", "c").groupBy("lead", "b", "c")


def may_link(near: DataFrame, percent: int) -> DataFrame:
    """lead, sid: the sets of stars that may link with one that doesn't link with the leader, and those ones, by their sketches."""

    def match(t: pa.Table) -> pa.Table:
        n, sid, is_row = (t.column(x).to_numpy() for x in ("n", "sid", "is_row"))
        bits = joined(t, "sketch", U64).reshape(len(n), -1)
        order = np.argsort(n, kind="stable")
        r, c = order[is_row[order]], order[~is_row[order]]
        found = np.zeros(len(n), bool)
        # linked sets have sizes in the ratio of percent at least, and 100 - percent entries apart for 100 + percent of both at most
        first, last = np.searchsorted(n[c], -(-n[r] * percent // 100)), np.searchsorted(n[c], n[r] * 100 // percent, "right")
        table = bits[c]
        for i, lo, hi in zip(r.tolist(), first.tolist(), last.tolist()):
            apart = np.bitwise_count(table[lo:hi] ^ bits[i]).sum(axis=1, dtype=np.int64)
            hit = c[lo:hi][((100 + percent) * apart <= (100 - percent) * (n[i] + n[c[lo:hi]])) & (sid[c[lo:hi]] != sid[i])]
            found[hit] = True
            found[i] |= len(hit) > 0
        some = np.unique(sid[found])
        return pa.table({"lead": np.full(len(some), t.column("lead")[0].as_py(), np.int64), "sid": some})

    return star_blocks(near).applyInArrow(match, "lead long, sid long").distinct()


def links_in_stars(diffs: DataFrame, percent: int) -> DataFrame:
    """a, b: links of sets that don't link with their leader to sets of the same leader; enough to join their groups."""

    def match(t: pa.Table) -> pa.Table:
        n, gone, sid, is_row, linked = (t.column(x).to_numpy() for x in ("n", "gone", "sid", "is_row", "linked"))
        n_lead = int(t.column("n_lead")[0].as_py())
        diff = [np.frombuffer(v, U64) for v in t.column("diff").to_pylist()]
        r, c = np.flatnonzero(is_row), np.flatnonzero(~is_row)
        if not len(r) or not len(c):
            return pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        common = n_lead - gone[r][:, None] - gone[c][None, :] + common_counts([diff[i] for i in r], [diff[i] for i in c])
        hit = (100 * common >= percent * (n[r][:, None] + n[c][None, :] - common)) & (sid[r][:, None] != sid[c][None, :])
        i, j = np.nonzero(hit)
        ids, code = np.unique(np.concatenate((sid[r[i]], np.where(linked[c[j]], t.column("lead")[0].as_py(), sid[c[j]]))), return_inverse=True)
        label = forest(code[: len(i)], code[len(i):], len(ids))
        some = label != np.arange(len(ids))
        return pa.table({"a": ids[some], "b": ids[label[some]]})

    return star_blocks(diffs).applyInArrow(match, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node each node reaches, by large and small stars in turn; every round is written."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        # large star: the larger neighbours of a node go to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(now)


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kid, tv, root (a set of the group; null: empty set)."""
    n = partitions(docs.sparkSession)
    docs = keyed(docs)
    known = written(classes(docs, shingle), "classes")
    pairs = written(choose_leaders(read_lists(postings(docs, shingle, percent, n), percent, n), percent), "pairs")
    near = written(against_leaders(pairs, members(docs, known, pairs, shingle), percent), "near")
    some = written(may_link(near, percent), "some")
    diffs = written(differences(some, members(docs, known, some, shingle), percent), "diffs")
    edges = near.where("linked").select(F.col("sid").alias("a"), F.col("lead").alias("b")).unionByName(links_in_stars(diffs, percent))
    roots = connected(edges)
    each = known.where("sid is not null").groupBy("sid").agg(F.min("kid").alias("kid")).join(roots, F.col("sid") == F.col("node"), "left").select("sid", "kid", F.coalesce("root", "sid").alias("root"))
    first = each.groupBy("root").agg(F.min("kid").alias("component"))
    of_set = each.join(first, "root").select("sid", "component", "root")
    out = known.join(of_set, "sid", "left")
    own = F.coalesce("component", "kid")
    return out.select("doc_id", "n_shingles", F.when(own != F.lit(-(2**63)), own).alias("component_id"), "kid", "tv", "root")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of each group the document with the smallest id stays (of rows that repeat it, one; of its texts under that id, the one
    with the smallest hash); a document with an empty set is a group of its own; all columns stay."""
    alone = [F.when(F.col("root").isNull(), F.col(c)) for c in ("kid", "tv")]
    lead = groups(docs, shingle, percent).groupBy("root", *alone).agg(F.min(F.struct("kid", "tv")).alias("k")).select("k.kid", "k.tv")
    return rows_keyed(docs).join(lead, ["kid", "tv"], "left_semi").dropDuplicates(["kid", "tv"]).select("row.*")
