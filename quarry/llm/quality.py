"""Quality rules with n-gram perplexity (operator 3).

The model is a modified Kneser-Ney model of characters, up to five long. A text is read as its white-space delimited words
with one space after each; a character's context, at most the four characters before it, reaches over the space to the last
two characters of the word before.
Spark counts the n-grams of the words of all documents and of what stands where two words meet, and estimates their
probabilities by joins and aggregations; workers write them as sorted arrays of 64-bit n-gram hashes to the shared
folder and map those files to score texts. No n-gram is left out or shares a count with another, and none passes through
the driver.

Only the first two characters of a word (its space among them) see the word before. So a word has two scores, each computed
once in a worker: that of its tail, which depends on the word, and that of its border, which depends on two characters on
either side.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, arrow_schema, by_list, coded, map_rows, persisted, resident, scattered, slices, word_codes
from quarry.sources.shared import remove, scratch

ORDER = 5
#: What stands before a text's first word; no word holds it.
START = "\n"
#: Characters on which the base rules count symbols.
SYMBOLS = "#*$%&|<>"
#: Rows of one array file, at most about.
SHARD = 250_000
#: Bytes of text whose words a worker handles together.
AT_ONCE = 4_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), the same in every process."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _codes(blocks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the blocks; the place in its block of each; and the block of each."""
    codes = np.frombuffer("".join(blocks).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, blocks), dtype=np.int64, count=len(blocks))
    block = np.repeat(np.arange(len(blocks)), sizes)
    return codes, np.arange(len(codes)) - (np.cumsum(sizes) - sizes)[block], block


class Hashes:
    """Hashes of the n-grams that end at given places of the codes, finished for those places alone."""

    def __init__(self, codes: np.ndarray):
        self.sums = [np.zeros(len(codes), dtype=np.uint64)]
        h, own = self.sums[0], _mix(codes + np.uint64(16))
        for n in range(1, ORDER + 1):
            h = h.copy()
            if len(own) >= n:
                h[n - 1 :] += own[: len(own) - n + 1]
            self.sums.append(h)
            own = own * np.uint64(0x9E3779B97F4A7C15)  # a character's share depends on its distance from the end

    def at(self, n: int, places: np.ndarray) -> np.ndarray:
        """Of order n, where 0 stands for the context of single characters."""
        return _mix(self.sums[n][places]).view(np.int64) if n else np.zeros(len(places), dtype=np.int64)


def tails(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Blocks of the words, each between spaces, and the place in each of its third character, the first that sees nothing
    before the word."""
    return [f" {w} " for w in words], np.full(len(words), 3)


def borders(blocks: list[str]) -> tuple[list[str], np.ndarray]:
    """Blocks of the last two characters of a word (or a space and all of it), a space and a beginning, or of START and a
    beginning; and the place where the beginning, the first two characters of a word and its space, begins."""
    return blocks, np.fromiter((1 if x[0] == START else x.find(" ", 1) + 1 for x in blocks), dtype=np.int64, count=len(blocks))


def border_codes(codes: np.ndarray, offsets: np.ndarray, words: list[str]) -> tuple[np.ndarray, list[str]]:
    """For each word of each text the code of the border before it, and the distinct borders by code."""
    if not len(codes):
        return codes, []
    own = pa.array(words, type=pa.string())
    ends = pc.utf8_slice_codeunits(pc.binary_join_element_wise(" ", own, ""), -2).dictionary_encode()
    begins = pc.utf8_slice_codeunits(pc.binary_join_element_wise(own, "", " "), 0, 2).dictionary_encode()
    before = np.zeros(len(codes), dtype=np.int64)
    before[1:] = ends.indices.to_numpy()[codes[:-1]] + 1
    firsts = offsets[:-1]
    before[firsts[firsts < len(codes)]] = 0
    n = len(begins.dictionary)
    kinds, of = np.unique(before * n + begins.indices.to_numpy()[codes], return_inverse=True)
    end = pa.array([START, *(f"{x} " for x in ends.dictionary.to_pylist())]).take(pa.array(kinds // n))
    return of, pc.binary_join_element_wise(end, begins.dictionary.take(pa.array(kinds % n)), "").to_pylist()


def _grams(blocks: list[str], scored_from: np.ndarray, times: np.ndarray, once: bool) -> Iterator[list]:
    """For each order the columns (gram, begins, count) of the n-grams that end at a block's scored places. Begins: with
    START or, unless `once`, any block. Counts are whole for the highest order and for n-grams that begin a block, START
    among them; of others it only matters that they are there, and they are suffixes of those of the order above."""
    codes, place, block = _codes(blocks)
    text = "".join(blocks)
    ends = np.flatnonzero(place >= scored_from[block])
    hashes, above = Hashes(codes), np.zeros(0, dtype=np.int64)
    for n in range(ORDER, 0, -1):
        at = ends[place[ends] >= n - 1] if n == ORDER else np.concatenate([above, ends[place[ends] == n - 1]])
        own = hashes.at(n, at)
        by = np.argsort(own)
        at, own = at[by], own[by]
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else at
        some = above = at[edge]
        if len(some):
            begins = codes[some - n + 1] == ord(START) if once else place[some] == n - 1
            yield [[text[i - n : i] for i in (some + 1).tolist()], begins, np.add.reduceat(times[block[at]], edge)]


def counted_blocks(docs: DataFrame, flush: int = 200_000) -> DataFrame:
    """(block, times): the words of all texts, the borders between them, and how often each stands there. A border holds a
    space or START, a word neither."""
    schema = "block string, times long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def add(codes: np.ndarray, blocks: list[str]):
            for block, n in zip(blocks, np.bincount(codes, minlength=len(blocks)).tolist()):
                if n:
                    seen[block] = seen.get(block, 0) + n

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(seen, type=pa.string()), pa.array(seen.values(), type=pa.int64())], schema=arrow)
            seen.clear()

        for batch in batches:
            for part in slices(batch.column(0), AT_ONCE):
                codes, offsets, words = word_codes(part)
                add(codes, words)
                add(*border_codes(codes, offsets, words))
                if len(seen) > flush:
                    yield from out()
        yield from out()

    rows = scattered(docs, "text").filter("text is not null").mapInArrow(run, schema)
    # words of one character are all border and no blocks
    return rows.filter("char_length(block) > 1").groupBy("block").agg(F.sum("times").alias("times"))


def count_grams(docs: DataFrame, once: bool = True) -> DataFrame:
    """(n, h, suffix, context, starts, c): how often each n-gram stands in all texts, or, with `once`, in how many of their
    distinct words and borders.

    starts: nothing is seen before the n-gram, for it begins a block (`once`: it begins a text). Tasks hand on an n-gram's
    characters, which take less than half of the disk of its hash and those of its suffix and its context.
    """
    schema = "gram string, starts int, c long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[pa.Array, np.ndarray]]] = {True: [], False: []}

        def out(whole: bool):
            blocks, times = zip(*held[whole])
            made, scored_from = (tails if whole else borders)([x for b in blocks for x in b.to_pylist()])
            for grams, begins, counts in _grams(made, scored_from, np.concatenate(times), once):
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(begins.astype(np.int32)), pa.array(counts)], schema=arrow)
            held[whole] = []

        for batch in batches:
            border = pc.match_substring_regex(batch.column(0), f"[ {START}]")
            for whole, own in ((True, pc.invert(border)), (False, border)):
                part = batch.filter(own)
                if part.num_rows:
                    held[whole].append((part.column(0), np.ones(part.num_rows, dtype=np.int64) if once else part.column(1).to_numpy()))
                if sum(len(t) for _, t in held[whole]) > 200_000:
                    yield from out(whole)
        for whole in (True, False):
            if held[whole]:
                yield from out(whole)

    # one row for each n-gram
    grams = counted_blocks(docs).mapInArrow(run, schema).groupBy("gram").agg(F.max("starts").alias("starts"), F.sum("c").alias("c"))
    return _hashed(grams)


def _hashed(grams: DataFrame) -> DataFrame:
    """(gram, starts, c) with the n-gram's order and hashes in place of its characters."""
    schema = "n int, h long, suffix long, context long, starts int, c long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.utf8_length(batch.column(0))
            for n in range(1, ORDER + 1):
                own = batch.filter(pc.equal(sizes, n))
                if own.num_rows:
                    codes, place, _ = _codes(own.column(0).to_pylist())
                    hashes, ends = Hashes(codes), np.flatnonzero(place == n - 1)
                    # the context is the (n-1)-gram that ends one place earlier; the suffix the one that ends here
                    columns = [np.full(len(ends), n, dtype=np.int32), hashes.at(n, ends), hashes.at(n - 1, ends), hashes.at(n - 1, ends - 1)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), own.column(1), own.column(2)], schema=arrow)

    return grams.mapInArrow(run, schema)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """The three discounts of one order from how many n-grams have counts one to four."""
    n1, n2, n3, n4 = (max(x, 1) for x in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(max(d, low), high) for d, low, high in zip(found, (0.1, 0.2, 0.3), (0.9, 1.8, 2.7))]


def estimate(grams: DataFrame) -> tuple[DataFrame | None, dict[int, int], float]:
    """Interpolated modified Kneser-Ney estimates as (kind, h, value), rows by kind, and the unknown character's value.

    Kind n holds the log probabilities of the n-grams, kind ORDER + n the log backoff weights of their contexts. An n-gram
    below the highest order counts how many different characters stand before it, and in full where none can (`starts`).
    A row for each order comes to the driver.
    """
    grams = persisted(grams)
    seen = grams.filter("n > 1").groupBy((F.col("n") - 1).alias("n"), F.col("suffix").alias("h")).agg(F.count("*").alias("seen"))
    whole = (F.col("n") == ORDER) | (F.col("starts") > 0)
    counted = persisted(grams.join(seen, ["n", "h"], "left").select("n", "h", "suffix", "context", F.when(whole, F.col("c")).otherwise(F.coalesce("seen", F.lit(1))).alias("c")))
    tallies = {r["n"]: r for r in counted.groupBy("n").agg(F.count("*").alias("rows"), F.sum("c").alias("total"), *[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()}
    if not tallies:
        return None, {}, -10.0
    discounts = {n: _discounts(r["n1"], r["n2"], r["n3"], r["n4"]) for n, r in tallies.items()}
    taken = F.lit(0.0)
    for n, d in discounts.items():
        taken = F.when(F.col("n") == n, F.element_at(F.array(*map(F.lit, d)), F.least("c", F.lit(3)).cast("int"))).otherwise(taken)
    counted = counted.withColumn("taken", taken)
    contexts = counted.groupBy("n", "context").agg(F.sum("c").alias("total"), (F.sum("taken") / F.sum("c")).alias("gamma"))
    share = ((F.col("c") - F.col("taken")) / F.col("total")).alias("alpha")
    shares = persisted(counted.join(contexts, ["n", "context"]).select("n", "h", "suffix", "context", share, "gamma"))
    uniform = 1 / (tallies[1]["rows"] + 1)

    def upper(n: int, lower: DataFrame) -> DataFrame:
        """Probabilities of order n from those below."""
        below = lower.select(F.col("h").alias("suffix"), F.col("p").alias("below"))
        return shares.filter(F.col("n") == n).join(below, "suffix").select("n", "h", (F.col("alpha") + F.col("gamma") * F.col("below")).alias("p"))

    made = shares.filter("n = 1").select("n", "h", (F.col("alpha") + F.col("gamma") * uniform).alias("p"))
    for low in range(1, ORDER, 2):  # two orders more at a time, each made once or twice
        two = upper(low + 1, made.filter(F.col("n") == low))
        more = two.unionByName(upper(low + 2, two)) if low + 2 <= ORDER else two
        made = persisted(made.unionByName(more)) if low + 2 < ORDER else made.unionByName(more)
    weights = contexts.select((F.col("n") + ORDER).alias("kind"), F.col("context").alias("h"), F.log("gamma").alias("value"))
    n1, n2, total = (tallies[1][x] for x in ("n1", "n2", "total"))
    unknown = math.log(sum(d * k for d, k in zip(discounts[1], (n1, n2, tallies[1]["rows"] - n1 - n2))) / total * uniform)
    rows = {n: r["rows"] for n, r in tallies.items()}  # and of contexts no more
    return made.select(F.col("n").alias("kind"), "h", F.log("p").alias("value")).unionByName(weights), rows | {n + ORDER: k for n, k in rows.items()}, unknown


def _opened(folder: str):
    """The folder's file system as pyarrow has it, and the folder's path there."""
    return pa.fs.FileSystem.from_uri(folder)


def write_arrays(table: DataFrame, rows: dict[int, int], folder: str) -> dict[int, tuple[int, int]]:
    """Writes (kind, h, value) as files of ascending hashes and their values; for each kind its first file and the
    logarithm of the number of its files, which `rows`, a bound on the rows of each kind, gives.

    A kind's rows are dealt out to files by their highest bits, so that a file's rows fit a task; the files of a kind, one
    after the other, are one sorted array. A file appears under its name when it is whole; a task that runs again writes
    the same once more.
    """
    layout, files = {}, 0
    for kind in sorted(rows):
        bits = max(0, (-(-rows[kind] // SHARD) - 1).bit_length())
        layout[kind] = files, bits
        files += 1 << bits
    file = F.lit(None).cast("int")
    for kind, (first, bits) in layout.items():
        own = F.lit(first) if not bits else (F.shiftright("h", 64 - bits) + (first + (1 << bits - 1))).cast("int")
        file = F.when(F.col("kind") == kind, own).otherwise(file)

    arrow = arrow_schema("file int, h long, value float")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema=arrow)
        store, path = _opened(folder)
        store.create_dir(path, recursive=True)
        of = held.column(0).to_numpy()
        for k in np.unique(of).tolist():
            h, value = (held.column(c).to_numpy()[of == k] for c in (1, 2))
            by = np.argsort(h, kind="stable")
            name = f"{path}/{k}.{uuid.uuid4().hex}"
            with store.open_output_stream(name) as f:
                f.write(h[by].astype("<i8").tobytes())
                f.write(value[by].astype("<f4").tobytes())
            store.move(name, f"{path}/{k}")
            yield pa.RecordBatch.from_pydict({"file": pa.array([k], pa.int32())})

    dealt = table.select(file.alias("file"), "h", F.col("value").cast("float").alias("value")).repartitionById(files, F.col("file"))
    dealt.mapInArrow(run, "file int").collect()  # a number for each file
    return layout


class Model:
    """The written arrays, read where they are used: mapped where the folder is a mounted one, else loaded."""

    def __init__(self, folder: str, layout: dict[int, tuple[int, int]], unknown: float):
        self.folder, self.layout, self.unknown = folder, layout, unknown
        self.files: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"files": {}}

    def _file(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.files:
            store, path = _opened(self.folder)
            path = f"{path}/{k}"
            if isinstance(store, pa.fs.LocalFileSystem):
                raw = np.memmap(path, dtype=np.uint8, mode="r")
            else:
                with store.open_input_stream(path) as f:
                    raw = np.frombuffer(f.read(), dtype=np.uint8)
            n = len(raw) // 12
            self.files[k] = raw[: 8 * n].view("<i8"), raw[8 * n :].view("<f4")
        return self.files[k]

    def find(self, kind: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is there, and its value."""
        found, values = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.float32)
        if kind not in self.layout:
            return found, values
        first, bits = self.layout[kind]
        if not bits:
            parts = [(first, slice(None))]
        else:  # places by file
            of = (h >> np.int64(64 - bits)) + (1 << bits - 1)
            by = np.argsort(of, kind="stable")
            files, starts = np.unique(of[by], return_index=True)
            parts = list(zip((files + first).tolist(), np.split(by, starts[1:])))
        for k, own in parts:
            keys, data = self._file(k)
            if len(keys) and len(h):
                at = np.minimum(np.searchsorted(keys, h[own]), len(keys) - 1)
                found[own], values[own] = keys[at] == h[own], data[at]
        return found, values

    def score(self, blocks: list[str], scored_from: np.ndarray) -> np.ndarray:
        """Sum of the log probabilities of each block's scored characters."""
        codes, place, block = _codes(blocks)
        hashes = Hashes(codes)
        todo = np.flatnonzero(place >= scored_from[block])
        logp = np.zeros(len(codes))
        for n in range(ORDER, 0, -1):
            fits = place[todo] >= n - 1
            own = todo[fits]
            found, values = self.find(n, hashes.at(n, own))
            logp[own[found]] += values[found]
            miss = own[~found]
            if n > 1:
                known, weight = self.find(ORDER + n, hashes.at(n - 1, miss - 1))
                logp[miss[known]] += weight[known]
            else:
                logp[miss] += self.unknown
            todo = np.concatenate([todo[~fits], miss]) if n > 1 else todo[:0]
        return np.bincount(block, weights=logp, minlength=len(blocks))


def fit(docs: DataFrame, once: bool = True) -> Model:
    """The model of all texts, of counts as `count_grams` has them; its arrays lie in the shared folder until they are
    removed."""
    spark: SparkSession = docs.sparkSession
    folder = scratch(spark, "ngrams")
    table, rows, unknown = estimate(count_grams(docs, once))
    return Model(folder, write_arrays(table, rows, folder) if table is not None else {}, unknown)


class Memo:
    """Scores of strings, kept in two generations of about `keep` strings of up to `longest` characters."""

    def __init__(self, score, keep: int, longest: int = 48):
        self.score, self.keep, self.longest = score, keep, longest
        self.new: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def of(self, kinds: list[str]) -> np.ndarray:
        """The score of each of a list of distinct strings."""
        if len(self.new) > self.keep:
            self.old, self.new = self.new, {}
        got = list(map(self.new.get, kinds))
        unknown = []
        for i, x in enumerate(got):
            if x is None:
                got[i] = x = self.old.get(kinds[i])
                if x is None:
                    unknown.append(i)
                else:
                    self.new[kinds[i]] = x
        for at in range(0, len(unknown), 20_000):
            part = [kinds[i] for i in unknown[at : at + 20_000]]
            for i, w, x in zip(unknown[at : at + 20_000], part, self.score(part).tolist()):
                got[i] = x
                if len(w) <= self.longest:
                    self.new[w] = x
        return np.array(got, dtype=np.float64)


class Scorer:
    """Scores of words after the word before them; of their tails and borders a worker remembers some."""

    def __init__(self, model: Model, keep: int = 100_000):
        self.tails = Memo(lambda words: model.score(*tails(words)), keep)
        self.borders = Memo(lambda blocks: model.score(*borders(blocks)), keep)

    def words(self, codes: np.ndarray, offsets: np.ndarray, words: list[str]) -> np.ndarray:
        """Log probability of each word of each text."""
        scores = np.zeros(len(words))
        long = [i for i, w in enumerate(words) if len(w) > 1]
        scores[long] = self.tails.of([words[i] for i in long])
        of, found = border_codes(codes, offsets, words)
        return scores[codes] + self.borders.of(found)[of] if len(codes) else scores[codes]


def repeated(codes: np.ndarray, offsets: np.ndarray, window: int = 8) -> np.ndarray:
    """For each list of codes, how many lie in a window of eight that occurs twice or more in the list, the first
    included. Hashes of the windows find candidates; windows are then compared code by code."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    n = len(codes) - window + 1
    if n < 2:
        return out
    row = np.repeat(np.arange(len(out)), np.diff(offsets))
    h = row[:n].astype(np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n].astype(np.uint64) + np.uint64(1)
    h = _mix(h)
    inside = row[:n] == row[window - 1 :]
    in_order = np.sort(h[inside])
    twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    if not len(twice):
        return out
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    groups: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(inside & (twice[at] == h)).tolist():
        groups.setdefault((int(row[i]), codes[i : i + window].tobytes()), []).append(i)
    covered = np.zeros(len(codes) + 1, dtype=np.int64)
    for places in groups.values():
        if len(places) > 1:
            covered[places] += 1
            covered[np.array(places) + window] -= 1
    return np.bincount(row, weights=np.cumsum(covered)[:-1] > 0, minlength=len(out)).astype(np.int64)


def dup_lines(texts: pa.Array) -> np.ndarray:
    """For each text, lines with a word that equal an earlier line of it."""
    codes, offsets, lines = coded(pc.split_pattern(texts, "\n"))
    with_word = np.array([bool(x.strip(SPACES)) for x in lines])[codes]
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))[with_word]
    kinds = np.unique(row * max(len(lines), 1) + codes[with_word]) // max(len(lines), 1)
    return np.bincount(row, minlength=len(texts)) - np.bincount(kinds, minlength=len(texts))


MEASURED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, logp double, n_scored long, lang string"


def measured(docs: DataFrame, model: Model) -> DataFrame:
    """The base counts of every whole text, with the sum of log probabilities and the number of scored characters."""
    key = uuid.uuid4().hex

    def of(batch):
        scorer = resident(("scorer", key), lambda: Scorer(model))
        parts = []
        for texts in slices(batch.column(1), AT_ONCE):
            codes, offsets, words = word_codes(texts)
            scores = scorer.words(codes, offsets, words)
            size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            symbols = sum(pc.count_substring(texts, c).to_numpy().astype(np.int64) for c in SYMBOLS)
            # each text's scores are summed by themselves, so that its result does not depend on the texts around it
            n = np.diff(offsets)
            logp = np.add.reduceat(np.append(scores, 0.0), offsets[:-1]) * (n > 0)
            chars = by_list(size[codes], offsets)
            # every character of a word and the space after it are scored
            parts.append((n, chars, symbols, dup_lines(texts), repeated(codes, offsets), logp, chars + n))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "logp", "n_scored")
        return {n: np.concatenate(c) for n, c in zip(names, zip(*parts))} | {"doc_id": batch.column(0), "lang": batch.column(2)}

    return map_rows(scattered(docs, "doc_id", "text", "lang"), of, MEASURED)


#: Half-widths of the bands, in robust standard deviations.
UPPER, LOWER = 3.0, 3.0
#: A language with fewer distinct texts, or with less than half of the spread of all languages, takes the spread of all.
LEAST_TEXTS = 100


def _bands(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """The median log perplexity and the spread of the deviations of each band, over texts that pass the base rules.

    Copies and other orders of the same words have the same score and count once, so a group of copies of any size is one
    text. Where too few texts, or many near copies, leave a band no spread of its own, that of all bands stands in. A band
    is without a spread where even that is not above rounding.
    """
    score = F.round(F.col("log_ppl") * 1e9).cast("long")
    texts = rows.filter(~F.col("base_failed") & F.col("log_ppl").isNotNull()).groupBy("band", "n_scored", score.alias("score")).agg(F.min("log_ppl").alias("log_ppl"))

    def quantile(column: str, share: float):
        return F.percentile_approx(column, F.lit(share), F.lit(20_000)).alias("q")

    median = {r["band"]: r["q"] for r in texts.groupBy("band").agg(quantile("log_ppl", 0.5)).collect()}
    away = texts.select("band", _deviation(median).alias("deviation"))
    own = {r["band"]: (r["n"], -r["q"] / 0.6745) for r in away.groupBy("band").agg(F.count("*").alias("n"), quantile("deviation", 0.25)).collect()}
    pooled = -(away.agg(quantile("deviation", 0.25)).first()["q"] or 0.0) / 0.6745
    spread = {band: x if n >= LEAST_TEXTS and 2 * x >= pooled else pooled for band, (n, x) in own.items()}
    return median, {band: x for band, x in spread.items() if x >= 1e-3}


def _of_band(found: dict[str, float]):
    """The band's value, by a map literal: one entry a language."""
    made = F.create_map(*[x for k, v in found.items() for x in (F.lit(k), F.lit(float(v)))]) if found else F.lit(None).cast("map<string,double>")
    return F.try_element_at(made, F.col("band"))


def _deviation(median: dict[str, float]):
    return (F.col("log_ppl") - _of_band(median)) * F.sqrt("n_scored")


def assess(docs: DataFrame, once: bool = True) -> DataFrame:
    """Base counts, base_failed, perplexity and kept, for each row. The model counts n-grams as often as they stand in the
    texts, or, with `once`, in how many distinct words and borders.

    A text's log perplexity is minus its mean log probability over characters. Its distance from the median of its
    language (null: a group of its own), times the root of the number of characters averaged, is its deviation; the
    lower quartile of the deviations gives their spread, because bad texts mostly lie above. Texts beyond UPPER or LOWER
    spreads are rejected. Median and quartile are taken over the distinct texts that pass the base rules (`_bands`). Null
    text has no words and fails them. Rows repeat as they come; an empty table gives no rows.
    """
    model = fit(docs, once)
    rows = persisted(measured(docs, model))
    remove(docs.sparkSession, model.folder)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "log_ppl": F.when(F.col("n_scored") > 0, -F.col("logp") / F.col("n_scored")), "band": F.coalesce("lang", F.lit(""))})
    median, spreads = _bands(rows)
    rows, spread = rows.withColumn("deviation", _deviation(median)), _of_band(spreads)
    outside = (F.col("deviation") > UPPER * spread) | (F.col("deviation") < -LOWER * spread)
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.exp("log_ppl").alias("perplexity")
    )
