"""Best-fit packing of tokenised documents into sequences of a fixed length.

Pieces matter only by length, so packing is planned on the histogram of lengths
(at most ``capacity`` numbers, however many documents). The configuration
linear program - how often to use each way to fill a sequence, so that every
length is covered - is solved by multiplicative weights: a length's price falls
as its coverage grows, and the dearest configurations under the prices are found
by a knapsack dynamic program, one for each length that isn't covered yet. The
prices also bound from below how many sequences any packing has. Usages are
rounded, what is left is solved as a program again, and the last rest is packed
by best fit decreasing. Pieces take their places by their rank among pieces of
equal length.

Defined results: null text is empty and has the end token only; equal rows are
packed separately; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import power_of_two, saved, ship

CAPACITY = 2048
END_ID = 0
#: Rounds of multiplicative weights, how sharply prices fall with coverage, and how far below the dearest a used configuration may be.
ROUNDS, SHARPNESS, NEAR = 30, 3.0, 0.01
#: How much of a length is covered in a round: its share of so many lengths, at least the smallest step.
MANY, SMALLEST_STEP = 1_000, 0.05
#: Programs solved one after the other, each over what the last one's rounding left, and how close to the bound no other rounding is tried.
PHASES, CLOSE = 3, 1e-4
#: Runs of so much white space are left to the file's own tokenizer: the quicker one's regular expression overflows its stack on a million.
LONG_BLANK = 100_000

#: Fixed value: how byte-level BPE divides text before merging. White space at the end is taken without trying shorter runs; what
#: is left for the last branch is a single character, so the pieces are those of the usual \s+(?!\S)|\s+.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s++$|\s+(?!\S)|\s"

_loaded: dict[str, WordEncoder] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_by_character() -> dict[str, int]:
    """Vocabulary files show printable Latin-1 bytes as they are, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}


class WordEncoder:
    """Token ids of texts as little-endian bytes.

    The vocabulary of a byte-level BPE file lists tokens in the order of their
    merges, so its ids serve as ranks for the quicker of the two encoders at hand;
    tests hold the ids against the file's own tokenizer. Every text is encoded in
    one call: taking it apart into words and remembering theirs cost more than
    merging them again. A text that holds a special token's name is left to the
    file's own tokenizer, which reads the name as that token, as is one with a very
    long run of white space.
    """

    blank = re.compile(rf"(?<!\s)\s{{{LONG_BLANK}}}")

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.path, self.own = path, None
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        byte = _bytes_by_character()
        ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in self.special}
        self.encoder = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def by_file(self, text: str) -> bytes:
        from tokenizers import Tokenizer

        self.own = self.own or Tokenizer.from_file(self.path)
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def left_to_file(self, text: str) -> bool:
        return any(name in text for name in self.special) or len(text) >= LONG_BLANK and self.blank.search(text) is not None

    def encode(self, texts: list[str]) -> list[bytes]:
        quick = self.encoder.encode_to_numpy
        return [self.by_file(t) if self.left_to_file(t) else quick(t, disallowed_special=()).tobytes() for t in texts]


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches):
        if path not in _loaded:
            _loaded[path] = WordEncoder(path)
        encoder = _loaded[path]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = part.column("doc_id")
                rows, piece, start, length, crc, tokens = ([] for _ in range(6))
                for row, data in enumerate(encoder.encode([t or "" for t in part.column("text").to_pylist()])):
                    data += END_ID.to_bytes(4, "little")
                    n = len(data) // 4
                    at, k = 0, 0
                    while at < n:
                        size = (n % capacity or capacity) if at == 0 and n > capacity else min(capacity, n - at)
                        own = data[4 * at : 4 * (at + size)]
                        rows.append(row), piece.append(k), start.append(at), length.append(size), crc.append(zlib.crc32(own))
                        if with_ids:
                            tokens.append(np.frombuffer(own, np.int32))
                        at, k = at + size, k + 1
                out = [ids.take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array(tokens, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def knapsack(sizes: np.ndarray, most: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, list, list]:
    """Bounded knapsack: the highest total price in each room up to ``capacity``, its steps and which rooms took each."""
    best, steps, took = np.zeros(capacity + 1), [], []
    for i, (s, m, p) in enumerate(zip(sizes.tolist(), most.tolist(), prices.tolist(), strict=True)):
        m, k = int(min(m, capacity // s)), 1
        while m > 0:  # 1, 2, 4, ... and the rest, so that every number up to m can be made
            x = min(k, m)
            m, k, w = m - x, 2 * k, x * s
            gain = best[: capacity + 1 - w] + x * p
            better = gain > best[w:] + 1e-12
            taken = np.zeros(capacity + 1, bool)
            taken[w:] = better
            best[w:][better] = gain[better]
            steps.append((i, x, w))
            took.append(taken)
    return best, steps, took


def filled(steps: list, took: list, room: np.ndarray) -> list[dict[int, int]]:
    """The dearest configurations of several rooms: how many of which size."""
    room, out = room.copy(), [{} for _ in room]
    for (i, x, w), taken in zip(reversed(steps), reversed(took), strict=True):
        for h in np.flatnonzero(taken[room]):
            out[h][i] = out[h].get(i, 0) + x
            room[h] -= w
    return out


class Relaxation:
    """An approximate solution of the configuration program of a histogram.

    usage: configurations (places in ``sizes`` and their numbers) and how often
    each is used; bound: the greatest value of the dual program that the prices
    gave, so that no packing has fewer sequences; prices: those of that bound.
    """

    def __init__(self, counts: dict[int, int], capacity: int, rounds: int = ROUNDS):
        self.sizes, self.capacity = np.array(sorted(counts, reverse=True), np.int64), capacity
        n = np.array([counts[s] for s in self.sizes.tolist()], float)
        self.usage: dict[tuple, float] = {}
        self.bound, self.prices, self.best = 0.0, self.sizes / capacity, 1.0
        covered = np.zeros(len(n))
        # few lengths are covered in small steps, many in large ones, with about as much work
        most = min(1.0, max(SMALLEST_STEP, len(n) / MANY))
        for _ in range(math.ceil(rounds / most) if len(n) else 0):
            todo = np.flatnonzero(covered < 1 - 1e-9)
            if not len(todo):
                break
            # what a token costs falls as the coverage of its length grows
            prices = self.sizes * np.exp(-SHARPNESS * np.minimum(covered - covered.min(), 50))
            prices[covered >= 1 - 1e-9] = 0
            prices /= prices.max()
            best, steps, took = knapsack(self.sizes, n, prices, capacity)
            if (bound := float((prices * n).sum() / best[capacity])) > self.bound:
                self.bound, self.prices, self.best = bound, prices, float(best[capacity])
            # of one table: for each length that isn't covered, the dearest configuration that holds it
            near = todo[prices[todo] + best[capacity - self.sizes[todo]] >= (1 - NEAR) * best[capacity]]
            near = near[np.argsort(covered[near], kind="stable")]
            gained = np.zeros(len(n))
            for i, config in zip(near.tolist(), filled(steps, took, capacity - self.sizes[near]), strict=True):
                config[i] = config.get(i, 0) + 1
                if any(m > n[j] for j, m in config.items()):
                    continue
                step = min(min(1 - covered[j], most - gained[j]) * n[j] / m for j, m in config.items())
                if step > 1e-9:
                    key = tuple(sorted(config.items()))
                    self.usage[key] = self.usage.get(key, 0.0) + step
                    for j, m in key:
                        covered[j] += step * m / n[j]
                        gained[j] += step * m / n[j]

    def waste(self, key: tuple) -> float:
        """How far a configuration's price is below the dearest one's."""
        return 1 - sum(self.prices[j] * m for j, m in key) / self.best

    def rounded(self, left: dict[int, int], up: bool, waste: float) -> list[tuple[int, dict[int, int]]]:
        """Whole usages, the dearest configurations first, taken out of ``left``; up: at least one of each."""
        out = []
        for key, x in sorted(self.usage.items(), key=lambda kv: (self.waste(kv[0]), -kv[1], kv[0])):
            if self.waste(key) > waste + 1e-9:
                break
            k = min(max(int(x), int(up)), *(left.get(int(self.sizes[j]), 0) // m for j, m in key))
            if k:
                out.append((k, {int(self.sizes[j]): m for j, m in key}))
                for j, m in key:
                    left[int(self.sizes[j])] -= k * m
        return out


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit decreasing on a histogram: (how often, configuration)."""
    free: dict[int, list[list]] = {}
    full: list[tuple[int, dict[int, int]]] = []

    def put(left: int, k: int, config: dict[int, int]):
        if k and left:
            free.setdefault(left, []).append([k, config])
        elif k:
            full.append((k, config))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        for left in range(s, capacity) if n else ():
            fits = left // s
            while n and free.get(left):
                k, config = free[left].pop()
                used = min(k, n // fits)
                put(left, k - used - (1 if used < k and n - used * fits else 0), config)
                put(left - fits * s, used, config | {s: fits})
                if used < k and (rest := n - used * fits):
                    put(left - rest * s, 1, config | {s: rest})
                    used, n = used, used * fits
                n -= used * fits
            if not n:
                break
        fits = capacity // s
        put(capacity - fits * s, n // fits, {s: fits})
        if n % fits:
            put(capacity - (n % fits) * s, 1, {s: n % fits})
    return full + [(k, config) for groups in free.values() for k, config in groups]


def planned(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[int, dict[int, int]]], int, float]:
    """(how often to use which configuration so that the histogram is packed exactly, sequences that come from the program, its bound).

    The program is solved and rounded, and what is left is a smaller program of
    its own, ``PHASES`` times; best fit decreasing packs the last rest. The same
    solution may be rounded up or down, with or without wasteful configurations:
    the rounding with the fewest sequences counts.
    """
    whole = counts.get(capacity, 0)
    rest = {s: k for s, k in counts.items() if k and s != capacity}
    full = [(whole, {capacity: 1})] if whole else []
    first = Relaxation(rest, capacity, rounds)
    bound = first.bound + whole
    found: list[tuple[int, int, list]] = []
    for up, waste in ((True, 0.0), (True, NEAR), (False, 0.0), (False, NEAR)):
        left, used, program = dict(rest), [], first
        for phase in range(PHASES):
            if phase:
                program = Relaxation(left, capacity, rounds)
            taken = program.rounded(left, up, waste)
            left = {s: k for s, k in left.items() if k}
            used = used + taken
            plan = used + best_fit(left, capacity)
            found.append((sum(k for k, _ in plan), -sum(k for k, _ in used), plan))
            if not taken or not left:
                break
        if min(found, key=lambda f: f[:2])[0] + whole <= math.ceil(bound * (1 + CLOSE)):
            break
    n, used, plan = min(found, key=lambda f: f[:2])
    return full + plan, -used, bound


def configurations(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, dict[int, int]]]:
    """How often to use which configuration so that the histogram is packed exactly."""
    return planned(counts, capacity, rounds)[0]


def places(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, count in a sequence, first sequence, offset), in order of length and rank."""
    out, rank, sequence = [], {}, 0
    for k, config in plan:
        offset = 0
        for s, m in sorted(config.items(), reverse=True):
            out.append((s, rank.get(s, 0), m, sequence, offset))
            rank[s] = rank.get(s, 0) + k * m
            offset += s * m
        sequence += k
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset; with_ids: and their token ids."""
    spark = docs.sparkSession
    ship(spark)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = saved(docs.select("doc_id", "text").mapInArrow(_pieces(path or tokenizer_path(), capacity, with_ids), schema), "pieces")
    # a frequent length is counted in so many parts
    parts = power_of_two(pieces.count() / 512, 4096)
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    pieces = pieces.withColumn("part", part)
    cells = saved(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = {int(r["length"]): int(r["n"]) for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = places(configurations(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("rank", rank).join(offsets, ["length", "part"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))
    shift = 2**44
    keys = table[:, 0] * shift + table[:, 1]

    def run(batches):
        for batch in batches:
            s, r = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, s * shift + r, "right") - 1] if len(s) else np.zeros((0, 5), np.int64)
            local = r - row[:, 1]
            sequence, offset = row[:, 3] + local // np.maximum(1, row[:, 2]), row[:, 4] + local % np.maximum(1, row[:, 2]) * s
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    names = [f.split()[0] for f in schema.split(", ")]
    return ranked.select(*names, "rank").mapInArrow(run, schema + ", sequence_id long, offset long")


def op10(docs: DataFrame) -> DataFrame:
    return pack(docs)
