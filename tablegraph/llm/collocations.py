"""Phrases whose words occur together, mined with weighted acyclic automata.

Texts are split into pieces and words; everything is counted per language. Documents are dealt into
buckets, and every bucket does the same:

1. It asks the shards which of its word pairs are frequent in the whole corpus (hashes, so the answer
   can only be too wide). A longer phrase can be frequent only if each of its pairs is.
2. Its words and the phrases of up to four words that are left are sorted and written, one automaton
   for each range of prefixes, by incremental construction: the states behind the common prefix with
   the entry before are frozen and shared with any equal state. A state's weight is the count of the
   phrase that ends there.

A range (the hash of a phrase's first two words, or of its one word) gets an automaton from each bucket,
unions them with weights added, and drops what is rarer than ``least``; that is exact. The parts of a
phrase begin elsewhere, so every range writes the sorted parts that it asks about as automata too; the
owner composes them with its own, walking both at once, and returns the weights in order.

A phrase's score is that of its weakest cut, ``floor(2 * 10**6 * a / (l + r))``. Phrases that make up most
of the occurrences of one of their own inner phrases replace it. Whole numbers throughout.

Null texts are empty, a null language is ``und``. Empty texts and tables give no rows; repeated rows count
as often as they occur; ties are ranked by the bytes of the phrase. Only the columns named are read. A word
or phrase in a third of all documents is one entry for each bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegraph.llm import words
from tablegraph.llm.exchange import key_bits, pack, pack_sorted, pieces, unpack, unpack_sorted
from tablegraph.llm.frame import bucketed, quoted, tuned, width
from tablegraph.session import checkpoint

LONGEST = 4
TABLES = words.byte_tables(b" \t", b".,;:!?\n\x0b\x0c\r")

ASKED = "shard int, bucket int, keys binary, counts binary"
TOLD = "bucket int, shard int, bits int, frequent binary"
AUTOMATON = "labels array<string>, states binary, arcs binary"
PIECE = f"owner int, {AUTOMATON}"
TOTAL = f"owner int, langs array<string>, sums array<bigint>, {AUTOMATON}"
REQUEST = f"owner int, asker int, {AUTOMATON}"
REPLY = "asker int, owner int, weights binary"
PHRASE = "lang string, phrase string, a long, l array<bigint>, r array<bigint>"


class Automaton:
    """An acyclic automaton over words whose states carry weights; targets come before sources.

    The first label of a path is its language. ``states`` has the weight and the number of arcs of each
    state, ``arcs`` the label and target of each arc, in order; the last state is the start.
    """

    def __init__(self, labels: list[str], states: np.ndarray, arcs: np.ndarray):
        self.labels, self.weights = labels, states[:, 0]
        self.ends = np.cumsum(states[:, 1])
        self.starts = self.ends - states[:, 1]
        self.arc_labels, self.targets = arcs[:, 0], arcs[:, 1]
        self.states, self.arcs = states, arcs

    @classmethod
    def built(cls, labels: list[str], paths: np.ndarray, weights: np.ndarray) -> Automaton:
        """From sorted paths of label numbers (rows, -1 after the end), freezing what the next doesn't share."""
        known: dict = {}
        states: list[int] = []  # weight, number of arcs
        arcs: list[int] = []  # label, target
        lengths = (paths >= 0).sum(axis=1)
        shared = np.zeros(len(paths) + 1, np.int64)
        shared[1:-1] = np.cumprod(paths[1:] == paths[:-1], axis=1).sum(axis=1)
        # The open states: the label that leads to each, its weight, the arcs that leave it so far.
        size = paths.shape[1] + 1
        label, weight, leaving, depth = [0] * size, [0] * size, [[] for _ in range(size)], 0
        ends = [*zip(paths.tolist(), lengths.tolist(), weights.tolist(), strict=True), ((), 0, 0)]
        for (path, length, count), same in zip(ends, shared.tolist(), strict=True):
            while depth > same:
                own = leaving[depth]
                state = (weight[depth], *own) if own else weight[depth]
                at = known.get(state)
                if at is None:
                    at = known[state] = len(states) // 2
                    states += (weight[depth], len(own) // 2)
                    arcs += own
                if own:
                    leaving[depth] = []
                leaving[depth - 1] += (label[depth], at)
                depth -= 1
            while depth < length:
                depth += 1
                label[depth], weight[depth] = path[depth - 1], 0
            weight[depth] = count
        states += (0, len(leaving[0]) // 2)
        arcs += leaving[0]
        return cls(labels, np.array(states, np.int64).reshape(-1, 2), np.array(arcs, np.int64).reshape(-1, 2))

    def packed(self) -> tuple[list[str], bytes, bytes]:
        return self.labels, pack(self.states.reshape(-1)), pack(self.arcs.astype(np.uint32).reshape(-1))

    @classmethod
    def unpacked(cls, labels: list[str], states: bytes, arcs: bytes) -> Automaton:
        return cls(labels, unpack(states, np.int64).reshape(-1, 2),
                   unpack(arcs, np.uint32).astype(np.int64).reshape(-1, 2))

    def unfolded(self):
        """Of each length, all paths as rows of label numbers, in order, with their weights."""
        at, paths = np.array([len(self.states) - 1]), np.zeros((1, 0), np.int64)
        while len(at):
            many = self.ends[at] - self.starts[at]
            arc = np.repeat(self.starts[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            paths = np.column_stack([np.repeat(paths, many, axis=0), self.arc_labels[arc]])
            at = self.targets[arc]
            own = self.weights[at] > 0
            if len(at):
                yield paths[own], self.weights[at][own]

    def composed(self, asked: Automaton) -> list[int]:
        """The weight here of each path of the other automaton, in its order; 0 where there is none."""
        place = {x: i for i, x in enumerate(self.labels)}
        to = [place.get(x, -1) for x in asked.labels]
        mine: dict[int, dict[int, int]] = {}

        def arcs_of(s: int) -> dict[int, int]:
            if s not in mine:
                a, b = self.starts[s], self.ends[s]
                mine[s] = dict(zip(self.arc_labels[a:b].tolist(), self.targets[a:b].tolist(), strict=True))
            return mine[s]

        out, todo = [], [(len(asked.states) - 1, len(self.states) - 1)]
        starts, ends = asked.starts.tolist(), asked.ends.tolist()
        labels, targets, weights = asked.arc_labels.tolist(), asked.targets.tolist(), asked.weights.tolist()
        own = self.weights.tolist()
        while todo:
            there, here = todo.pop()
            if weights[there]:
                out.append(own[here] if here >= 0 else 0)
            found = arcs_of(here) if here >= 0 else {}
            todo += [(targets[i], found.get(to[labels[i]], -1))
                     for i in range(ends[there] - 1, starts[there] - 1, -1)]
        return out


def word_hashes(vocabulary) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))


def of_lang(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a word in a language, from the hashes of both."""
    return words.mixed(lang * words.ODD + word)


def of_pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return words.mixed(first * words.ODD + second)


def owner_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


class Bucket:
    """The words of a bucket's texts: sorted vocabulary, codes, languages, and the pairs inside pieces."""

    def __init__(self, docs: pa.Table):
        of, piece, flat = words.cut(words.column(docs, "text"), *TABLES)
        coded = flat.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words = coded.dictionary.take(pa.array(order)).to_pylist()
        self.code = place[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        self.langs = sorted(set(column := words.column(docs, "lang").to_pylist()))
        number = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.array([number[x] for x in column], np.int64)[of] if len(of) else np.zeros(0, np.int64)
        self.hashes = of_lang(word_hashes(self.langs)[self.lang], word_hashes(self.words)[self.code])
        self.inside = piece[1:] == piece[:-1]
        self.pairs = of_pair(self.hashes[:-1], self.hashes[1:])

    def entries(self, frequent: np.ndarray, ranges: int):
        """Paths (language and up to four words, -1 for none), counts and owners of all that is left."""
        size = max(1, len(self.words))
        found = []
        codes, at, counts = np.unique(
            self.lang * size + self.code, return_index=True, return_counts=True)
        found.append((at, 1, counts, owner_of(self.hashes[at], ranges)))
        starts = np.flatnonzero(frequent)
        chained, held = frequent, self.lang * size + self.code
        for n in range(2, LONGEST + 1):
            if n > 2:  # a phrase goes on where its last pair is frequent too
                chained = chained[:-1] & frequent[n - 2 :]
                starts = np.flatnonzero(chained)
            if not len(starts):
                break
            # ``held`` numbers the phrase of one word less at each place
            keys = held[starts] * size + self.code[starts + n - 1]
            _, first, inverse, counts = np.unique(
                keys, return_index=True, return_inverse=True, return_counts=True)
            at = starts[first]
            found.append((at, n, counts, owner_of(self.pairs[at], ranges)))
            held = np.full(len(self.code), -1, np.int64)
            held[starts] = inverse
        paths = np.full((sum(len(f[0]) for f in found), LONGEST + 1), -1, np.int64)
        row = 0
        for at, n, _, _ in found:
            paths[row : row + len(at), 0] = self.lang[at]
            for k in range(n):
                paths[row : row + len(at), k + 1] = self.code[at + k]
            row += len(at)
        return paths, np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])


def automata(paths: np.ndarray, weights: np.ndarray, owners: np.ndarray, langs: list[str], vocabulary: list[str]):
    """An automaton for each owner, from paths of a language's number and word numbers."""
    order = np.lexsort((*[paths[:, k] for k in range(paths.shape[1] - 1, -1, -1)], owners))
    paths, weights, owners = paths[order], weights[order], owners[order]
    edges = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1], [True]])) if len(owners) else []
    for a, b in zip(edges, edges[1:]):
        own = paths[a:b]
        # Labels: the languages, then the words of this piece.
        used = np.unique(own[:, 1:])
        used = used[used >= 0]
        rows = np.where(own[:, 1:] >= 0, np.searchsorted(used, own[:, 1:]) + len(langs), -1)
        # No word has a line feed, so a language never looks like a word.
        labels = ["\n" + x for x in langs] + [vocabulary[i] for i in used.tolist()]
        yield int(owners[a]), Automaton.built(labels, np.column_stack([own[:, 0], rows]), weights[a:b])


def nothing() -> Automaton:
    return Automaton.built([], np.zeros((0, LONGEST + 1), np.int64), np.zeros(0, np.int64))


def listed(automaton: Automaton) -> pa.Table:
    """``lang, phrase, weight`` of all paths, with every word of the phrase in ``w1`` to ``w4``."""
    labels = pa.array(automaton.labels, pa.large_string())
    parts = []
    for paths, weights in automaton.unfolded():
        if paths.shape[1] < 2:
            continue
        texts = [labels.take(pa.array(paths[:, k])) for k in range(paths.shape[1])]
        texts[0] = pc.utf8_slice_codeunits(texts[0], 1)
        texts += [pa.nulls(len(paths), pa.large_string())] * (LONGEST + 1 - len(texts))
        parts.append(pa.table([*texts, pa.array(weights)], names=["lang", "w1", "w2", "w3", "w4", "weight"]))
    return pa.concat_tables(parts) if parts else pa.table(
        [pa.array([], pa.large_string())] * 5 + [pa.array([], pa.int64())],
        names=["lang", "w1", "w2", "w3", "w4", "weight"])


class Phrases:
    """The phrases of a table of words as paths over a sorted vocabulary."""

    def __init__(self, table: pa.Table):
        self.langs = sorted(set(table["lang"].to_pylist()))
        vocabulary = set()
        for k in range(1, LONGEST + 1):
            vocabulary |= set(table[f"w{k}"].unique().to_pylist())
        self.words = sorted(vocabulary - {None}, key=str.encode)
        sets = [pa.array(self.langs, pa.large_string()), *[pa.array(self.words, pa.large_string())] * LONGEST]
        self.paths = np.column_stack([
            pc.fill_null(pc.index_in(words.column(table, c), s), -1).to_numpy().astype(np.int64)
            for c, s in zip(["lang", "w1", "w2", "w3", "w4"], sets, strict=True)])
        self.lengths = (self.paths[:, 1:] >= 0).sum(axis=1)

    def owners(self, paths: np.ndarray, ranges: int) -> np.ndarray:
        by_lang, by_word = word_hashes(self.langs), word_hashes(self.words)
        first = of_lang(by_lang[paths[:, 0]], by_word[paths[:, 1]])
        longer = paths[:, 2] >= 0
        second = of_lang(by_lang[paths[longer, 0]], by_word[paths[longer, 2]])
        hashes = first.copy()
        hashes[longer] = of_pair(first[longer], second)
        return owner_of(hashes, ranges)

    def parts(self):
        """Distinct parts of all cuts, and for each phrase and cut the numbers of both (-1 for no cut)."""
        rows, slots = [], []
        longer = np.flatnonzero(self.lengths > 1)
        for k in range(1, LONGEST):
            cut = longer[self.lengths[longer] > k]
            for side in (0, 1):
                got = np.full((len(cut), LONGEST + 1), -1, np.int64)
                got[:, 0] = self.paths[cut, 0]
                if side == 0:
                    got[:, 1 : k + 1] = self.paths[cut, 1 : k + 1]
                else:
                    got[:, 1 : LONGEST - k + 1] = self.paths[cut, k + 1 :]
                rows.append(got)
                slots.append((cut, k, side))
        every = np.concatenate(rows)
        distinct, inverse = np.unique(every, axis=0, return_inverse=True)
        numbers = np.full((len(self.paths), LONGEST - 1, 2), -1, np.int64)
        at = 0
        for cut, k, side in slots:
            numbers[cut, k - 1, side] = inverse.reshape(-1)[at : at + len(cut)]
            at += len(cut)
        return distinct, numbers


def automaton_column(rows: list[tuple]) -> dict:
    return {
        "labels": pa.array([r[0] for r in rows], pa.list_(pa.string())),
        "states": pa.array([r[1] for r in rows], pa.binary()), "arcs": pa.array([r[2] for r in rows], pa.binary())}


def read(row: dict) -> Automaton:
    return Automaton.unpacked(row["labels"], row["states"], row["arcs"])


def frequent_pairs(frame: DataFrame, shards: int, least: int) -> DataFrame:
    """Which of its distinct word pairs are frequent, for each bucket, in the order in which it asks."""
    bits = key_bits(shards)

    def ask(docs: pa.Table) -> pa.Table:
        own = Bucket(docs)
        keys, counts = np.unique(own.pairs[own.inside] >> np.uint64(64 - bits), return_counts=True)
        rows = [(s, pack_sorted(keys[a:b]), pack(counts[a:b].astype(np.uint32)))
                for s, a, b in pieces(keys, bits, shards)]
        bucket = docs["bucket"][0].as_py()
        return pa.table({
            "shard": pa.array([r[0] for r in rows], pa.int32()),
            "bucket": pa.array([bucket] * len(rows), pa.int32()),
            "keys": pa.array([r[1] for r in rows], pa.binary()),
            "counts": pa.array([r[2] for r in rows], pa.binary())})

    def answer(asked: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in words.column(asked, "keys").to_pylist()]
        counts = [unpack(x, np.uint32) for x in words.column(asked, "counts").to_pylist()]
        _, entry = np.unique(np.concatenate(keys), return_inverse=True)
        enough = (np.bincount(entry, np.concatenate(counts)) >= least)[entry]
        ends = np.cumsum([len(k) for k in keys])
        n = asked.num_rows
        return pa.table({
            "bucket": words.column(asked, "bucket"), "shard": words.column(asked, "shard"),
            "bits": pa.array([bits] * n, pa.int32()),
            "frequent": pa.array([np.packbits(x).tobytes() for x in np.split(enough, ends[:-1])], pa.binary())})

    return frame.groupBy("bucket").applyInArrow(ask, ASKED).groupBy("shard").applyInArrow(answer, TOLD)


def shard_automata(frame: DataFrame, told: DataFrame, ranges: int) -> DataFrame:
    """An automaton for each bucket and range: the bucket's words and phrases of frequent pairs."""

    def build(docs: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows:
            own = Bucket(docs)
            frequent = np.zeros(len(own.pairs), bool)
            rows = sorted(replies.to_pylist(), key=lambda r: r["shard"])
            if rows:
                keys = own.pairs[own.inside] >> np.uint64(64 - rows[0]["bits"])
                distinct, entry = np.unique(keys, return_inverse=True)
                found = [(int(s), b - a) for s, a, b in pieces(distinct, rows[0]["bits"], ranges)]
                enough = np.concatenate([
                    np.unpackbits(np.frombuffer(r["frequent"], np.uint8), count=n)
                    for r, (_, n) in zip(rows, found, strict=True)]).astype(bool)
                frequent[own.inside] = enough[entry]
            out = [(owner, *a.packed()) for owner, a in automata(
                *own.entries(frequent, ranges), own.langs, own.words)]
        return pa.table({"owner": pa.array([r[0] for r in out], pa.int32()),
                         **automaton_column([r[1:] for r in out])})

    return frame.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(build, PIECE)


def united(shards: DataFrame, ranges: int, least: int) -> DataFrame:
    """One automaton for each range, of what is frequent, and how many words each language has in it."""

    def unite(got: pa.Table) -> pa.Table:
        keys = ["lang", "w1", "w2", "w3", "w4"]
        # A few automata at a time, so that what they share is added up before the next are unfolded.
        held, waiting = [], 0
        for row in got.to_pylist():
            held.append(listed(read(row)))
            waiting += held[-1].num_rows
            if waiting > 1_000_000:
                held = [added(held, keys)]
                waiting = 0
        whole = added(held, keys)
        single = whole.filter(pc.is_null(whole["w2"]))
        sums = single.group_by("lang", use_threads=False).aggregate([("weight", "sum")])
        whole = whole.filter(pc.greater_equal(whole["weight"], least))
        own = Phrases(whole)
        owner = got["owner"][0].as_py()
        made = [a.packed() for _, a in automata(
            own.paths, whole["weight"].to_numpy(), np.zeros(whole.num_rows, np.int64), own.langs, own.words)]
        made = made or [nothing().packed()]
        return pa.table({
            "owner": pa.array([owner], pa.int32()),
            "langs": pa.array([sums["lang"].to_pylist()], pa.list_(pa.string())),
            "sums": pa.array([sums["weight_sum"].to_pylist()], pa.list_(pa.int64())),
            **automaton_column(made)})

    return shards.groupBy("owner").applyInArrow(unite, TOTAL)


def added(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    return pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate(
        [("weight", "sum")]).rename_columns({"weight_sum": "weight"})


def with_parts(total: DataFrame, ranges: int) -> DataFrame:
    """``lang, phrase, a, l, r``: the phrases of two words and more with the counts of all cuts' parts."""
    whole = total.select("owner", "labels", "states", "arcs")

    def asked(row: dict):
        table = listed(read(row))
        own = Phrases(table)
        parts, numbers = own.parts()
        owners = own.owners(parts, ranges)
        return table, own, parts, numbers, owners

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, own, parts, _, owners = asked(row)
                out = [(owner, *a.packed()) for owner, a in automata(
                    parts, np.ones(len(parts), np.int64), owners, own.langs, own.words)]
                yield from pa.table({
                    "owner": pa.array([r[0] for r in out], pa.int32()),
                    "asker": pa.array([row["owner"]] * len(out), pa.int32()),
                    **automaton_column([r[1:] for r in out])}).to_batches()

    def compose(own: pa.Table, requests: pa.Table) -> pa.Table:
        rows = requests.to_pylist()
        mine = read(own.to_pylist()[0]) if own.num_rows else nothing()
        return pa.table({
            "asker": pa.array([r["asker"] for r in rows], pa.int32()),
            "owner": pa.array([r["owner"] for r in rows], pa.int32()),
            "weights": pa.array([pack(np.array(mine.composed(read(r)), np.int64)) for r in rows], pa.binary())})

    def gather(own: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in own.to_pylist():
            table, phrases, parts, numbers, owners = asked(row)
            weights = np.zeros(len(parts), np.int64)
            # Parts are in the order of their paths, as each automaton lists them.
            order = np.argsort(owners, kind="stable")
            got = sorted(replies.to_pylist(), key=lambda r: r["owner"])
            weights[order] = np.concatenate(
                [unpack(r["weights"], np.int64) for r in got]) if got else np.zeros(0, np.int64)
            pick = np.flatnonzero(phrases.lengths > 1)
            sides = [[weights[numbers[pick, k, side]] for k in range(LONGEST - 1)] for side in (0, 1)]
            has = [numbers[pick, k, 0] >= 0 for k in range(LONGEST - 1)]
            many = np.sum(has, axis=0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
            l, r = (pa.ListArray.from_arrays(offsets, pa.array(
                np.stack(s, axis=1)[np.stack(has, axis=1)])) for s in sides)
            found = table.take(pa.array(pick))
            out.append(pa.table({
                "lang": found["lang"].cast(pa.string()),
                "phrase": pc.binary_join_element_wise(
                    *[words.column(found, f"w{k}") for k in range(1, LONGEST + 1)],
                    pa.scalar(" ", pa.large_string()), null_handling="skip").cast(pa.string()),
                "a": found["weight"], "l": l, "r": r}))
        kind = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()),
                          ("l", pa.list_(pa.int64())), ("r", pa.list_(pa.int64()))])
        return pa.concat_tables([o.cast(kind) for o in out]) if out else kind.empty_table()

    requests = whole.mapInArrow(ask, REQUEST)
    replies = whole.groupBy("owner").cogroup(requests.groupBy("owner")).applyInArrow(compose, REPLY)
    asker = whole.withColumnRenamed("owner", "asker").select(
        F.col("asker"), F.col("asker").alias("owner"), "labels", "states", "arcs")
    return asker.groupBy("asker").cogroup(replies.groupBy("asker")).applyInArrow(gather, PHRASE)


def mined(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best ``top`` phrases.

    ``least`` is the smallest count of a phrase; one goes if a longer one around it has ``share`` hundredths
    of its count.
    """
    spark = tuned(docs.sparkSession)
    ranges = width(spark)
    given = docs.select(
        quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"),
        F.coalesce(quoted(lang_col), F.lit("und")).alias("lang"))
    frame = bucketed(given).select("bucket", "text", F.col("rest.lang").alias("lang"))
    told = frequent_pairs(frame, ranges, least)
    total = checkpoint(united(shard_automata(frame, told, ranges), ranges, least))
    sizes = total.select(F.inline(F.arrays_zip("langs", "sums"))).groupBy(F.col("langs").alias("lang")).agg(
        F.sum("sums").alias("n"))
    found = checkpoint(with_parts(total, ranges))
    split = F.split("phrase", " ")
    # Inner phrases of two words and more, with the count of the phrase around them.
    spans = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(1), F.size(split) - 1), lambda i: F.transform(
            F.sequence(F.lit(2), F.size(split) - i + 1),
            lambda n: F.array_join(F.slice(split, i, n), " ")))),
        lambda p: p != F.col("phrase"))
    around = found.where(F.size(split) > 2).select("lang", F.explode(spans).alias("phrase"), "a").groupBy(
        "lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c: c.cast("decimal(20,0)")
    cuts = F.transform(F.arrays_zip("l", "r"), lambda c, k: F.struct(
        F.call_function("div", F.lit(2_000_000).cast("decimal(10,0)") * wide(F.col("a")),
                        wide(c["l"]) + wide(c["r"])).alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    hundred = F.lit(100).cast("decimal(10,0)")
    scored = found.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull()
        | (hundred * wide(F.col("longer")) < F.lit(share).cast("decimal(10,0)") * wide(F.col("a")))
    ).select("lang", "phrase", "a", F.array_min(cuts).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
