"""Pack token sequences into as few fixed-size sequences as there can be, by bin completion."""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import logging
import random
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positions, spool, spread
from .fractional import Filling, relaxed

#: Hash buckets a piece length is split into, so that no task holds a hot length.
SPREAD = 64
#: Words as they stand, and lowered plain words, whose ids a worker remembers: some 300 MB.
REMEMBERED, PLAIN = 250_000, 1_200_000

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


#: What may follow a plain word without changing how it is split: one run of other characters.
MARKS = ".,;:!?*#$%&"


@functools.lru_cache(maxsize=2)
def word_ids(path: str):
    """A function from a text to the ids of its words, as little-endian uint32 bytes.

    The tokenizer drops white space and no token spans it, so the ids of a text
    are those of its words in turn. It also lowers case and splits letters from
    marks, so a plain word with marks behind it has the ids of the lowered word
    and then of the marks. Words met before cost one look-up; a worker keeps a
    bounded number of them from task to task.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    plain: dict[str, bytes] = {}

    def encoded(word: str) -> bytes:
        found = plain.get(word)
        if found is None:
            ids = tokenizer.encode(word, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(plain) < PLAIN:
                plain[word] = found
        return found

    class Known(dict):
        def __missing__(self, raw: bytes) -> bytes:
            word = raw.decode("utf-8")
            stem = word.rstrip(MARKS)
            # Latin letters without combining marks: lowered alike by any library, and stable under NFC; one lowers to two characters
            split = stem.isalpha() and max(stem) < "\u0250" and "\u0130" not in stem
            found = encoded(stem.lower()) + (encoded(word[len(stem) :]) if len(stem) < len(word) else b"") if split else encoded(word)
            if len(self) < REMEMBERED:
                self[raw] = found
            return found

    known = Known()
    return lambda text: b"".join(map(known.__getitem__, text.encode("utf-8", "replace").split()))


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every document into pieces of at most capacity tokens: (doc_id, piece, start, length, ids_crc32).

    A document is its text's ids, then the end id; only longer ones are cut,
    and the last piece may be shorter. A null text is empty, so it gives the
    end id alone. Whole texts are encoded, one Arrow batch at a time.
    """
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_ids(tokenizer)
        for pdf in batches:
            rows: list[tuple] = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = encode(text) + last
                for k, b in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[b : b + 4 * capacity]
                    rows.append((doc, k, b // 4, len(cut) // 4, zlib.crc32(cut)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    # ids travel as text: pandas would make floats of long ids beside null ones
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, PIECES.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


#: Fillings of one waste that are looked at around a piece.
LOOKED = 64
#: Sequences that are opened beside the emptiest, first few and then more; that are completed anew to empty it; and how many are emptied so at most.
OPENED, COMPLETIONS, ROUNDS = (8, 32, 128), 8_192, 64
#: Levels that are entered to pack the pool of opened sequences.
SEARCHED = 1_000


class Lengths:
    """How many pieces of each length are left, with the lengths in order."""

    def __init__(self, counts: Mapping[int, int]):
        self.left = {x: n for x, n in counts.items() if n > 0}
        self.order = sorted(self.left)

    def largest(self, most: int) -> int | None:
        i = bisect.bisect_right(self.order, most)
        return self.order[i - 1] if i else None

    def take(self, length: int, n: int) -> None:
        """Take n pieces of a length, or put back -n."""
        was = self.left.get(length, 0)
        if was - n:
            self.left[length] = was - n
            if not was:
                bisect.insort(self.order, length)
        elif was:
            del self.left[length]
            self.order.pop(bisect.bisect_left(self.order, length))


def bound(counts: Mapping[int, int], capacity: int) -> int:
    """The fewest sequences that any packing needs: total length, or pieces over a half with what can't join them.

    For each k: pieces over capacity - k stand alone, and those from k to a half
    go into what the other pieces over a half leave, or need sequences more.
    """
    x = np.array(sorted(x for x, n in counts.items() if n > 0), np.int64)
    n = np.array([counts[int(v)] for v in x], np.int64)
    if not len(x):
        return 0
    upto = lambda values: np.concatenate([[0], np.cumsum(values)])
    number, total = upto(n), upto(x * n)
    k = np.append(x[2 * x <= capacity], 0)
    half = np.searchsorted(2 * x, capacity, "right")  # the first length over a half
    top = np.maximum(np.searchsorted(x, capacity - k, "right"), half)
    over = number[top] - number[half]
    small = total[half] - total[np.minimum(np.searchsorted(x, k), half)]
    room = capacity * over - (total[top] - total[half])
    need = number[-1] - number[top] + over + np.maximum(0, -(-(small - room) // capacity))
    return int(max(-(-total[-1] // capacity), need.max()))


def best_fit(counts: Mapping[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Each time the largest length left, then the largest that fits, again and again; as often as all of them last."""
    lengths, plan = Lengths(counts), []
    while lengths.order:
        room, way, x = capacity, {}, lengths.order[-1]
        while x is not None:
            way[x] = min(lengths.left[x], room // x)
            room -= way[x] * x
            x = lengths.largest(min(room, x - 1))
        times = min(lengths.left[x] // m for x, m in way.items())
        for x, m in way.items():
            lengths.take(x, m * times)
        plan.append((tuple(way.items()), times))
    return plan


def dominated(way: Filling, waste: int, free: int) -> bool:
    """Whether pieces of a filling could give way to one larger piece, or several to one as large, from the set bits of free."""
    one, more = 0, 0  # sums of one piece, and of several, as bits
    for x, times in way:
        for _ in range(times):
            one, more = one | 1 << x, more | (one | more) << x
    larger, span = (1 | one | more) << 1 if waste else 0, 1
    while span < waste:  # all sums raised by 1 to waste
        step = min(span, waste - span)
        larger, span = larger | larger << step, span + step
    return bool((more | larger) & free)


def fillings(left: Mapping[int, int], order: Sequence[int], room: int, spare: int, looked: int | None = LOOKED) -> Iterator[tuple[int, Filling]]:
    """Undominated ways to fill the room with a waste of at most spare: the least waste first.

    Of equal waste those of one piece come first, then those of two, the most
    alike first, as small pieces fit best in the end; then any, the larger first.
    At most `looked` of a waste are looked at, all with None.

    Sums that the lengths up to each one can make are bits of an integer, so the
    search only enters branches that lead to a filling of the waste in turn.
    """
    order = order[: bisect.bisect_right(order, room)]
    mask, sums, free = (1 << room + 1) - 1, [1], 0
    for x in order:
        reach, k, m = sums[-1], 1, min(left[x], room // x)
        while m > 0:
            n = min(k, m)
            reach |= reach << n * x & mask
            k, m = 2 * k, m - n
        sums.append(reach)
        free |= 1 << x

    def ways(goal: int, i: int) -> Iterator[Filling]:
        if not goal:
            yield ()
            return
        for j in range(min(i, bisect.bisect_right(order, goal)), 0, -1):
            if not sums[j] >> goal & 1:
                return  # nor with fewer lengths
            x = order[j - 1]
            for times in range(min(left[x], goal // x), 0, -1):
                if sums[j - 1] >> goal - times * x & 1:
                    for rest in ways(goal - times * x, j - 1):
                        yield ((x, times), *rest)

    def few(goal: int) -> Iterator[Filling]:
        if goal in left and goal:
            yield ((goal, 1),)
        for x in reversed(order[: bisect.bisect_right(order, goal // 2)]):
            if 2 * x == goal and left[x] > 1:
                yield ((x, 2),)
            elif 2 * x != goal and goal - x in left:
                yield ((goal - x, 1), (x, 1))

    for waste in range(min(spare, room) + 1):
        if sums[-1] >> room - waste & 1:
            for way in itertools.islice(itertools.chain(few(room - waste), ways(room - waste, len(order))), looked):
                gone = sum(1 << x for x, times in way if times == left[x])
                if not dominated(way, waste, free & ~gone):
                    yield waste, way


def complete(counts: Mapping[int, int], capacity: int, goal: int, nodes: int, seed: int | None = None) -> tuple[list[tuple[Filling, int]] | None, int]:
    """(a packing into at most goal sequences, or None; levels entered), by depth-first bin completion.

    Each level fills one sequence around the largest piece left, as often as its
    pieces last or once, and goes back when the waste is over what goal allows.
    None doesn't say that there is none (whole() can). With a seed, the first few
    fillings of a level come in any order, so that another part of the tree is seen.
    """
    lengths, plan, seen = Lengths(counts), [], 0
    rng = random.Random(seed)
    spare = goal * capacity - sum(x * n for x, n in counts.items())

    def choices(spare: int) -> Iterator[tuple[Filling, int, int]]:
        x, left, order = lengths.order[-1], dict(lengths.left), list(lengths.order)
        left[x] -= 1
        if not left[x]:
            del left[x]
            order.pop()
        ways = fillings(left, order, capacity - x, spare)
        if seed is not None:
            first = list(itertools.islice(ways, 6))
            rng.shuffle(first)
            ways = itertools.chain(first, ways)
        for waste, way in ways:
            whole = dict(way)
            whole[x] = whole.get(x, 0) + 1
            most = min(lengths.left[y] // m for y, m in whole.items())
            if waste:
                most = min(most, spare // waste)
            for times in dict.fromkeys((most, 1)):
                yield tuple(sorted(whole.items(), reverse=True)), times, waste * times

    if spare < 0 or not lengths.order:
        return (None if spare < 0 else []), 0
    levels = [choices(spare)]
    while levels:
        if len(plan) == len(levels):  # back from the level below: undo its choice
            way, times, waste = plan.pop()
            spare += waste
            for x, m in way:
                lengths.take(x, -m * times)
        found = next(levels[-1], None)
        if found is None:
            levels.pop()
            continue
        way, times, waste = found
        plan.append(found)
        spare -= waste
        for x, m in way:
            lengths.take(x, m * times)
        seen += 1
        if not lengths.order:
            return [(way, times) for way, times, _ in plan], seen
        if seen >= nodes:
            break
        levels.append(choices(spare))
    return None, seen


def search(counts: Mapping[int, int], capacity: int, goal: int, nodes: int) -> list[tuple[Filling, int]] | None:
    """A packing into at most goal sequences: the tree in order for a fifth of the nodes, then from the top in other orders."""
    found, seen = complete(counts, capacity, goal, nodes // 5)
    if found is not None or seen < nodes // 5:
        return found
    seed, depth = 0, len(counts)
    while seen < nodes:
        found, more = complete(counts, capacity, goal, min(nodes - seen, 2 * depth + 50), seed)
        if found is not None:
            return found
        seen, seed = seen + more + 1, seed + 1
    return None


def gathered(plan: Sequence[tuple[Filling, int]], capacity: int, others: int, most: int = COMPLETIONS) -> list[tuple[Filling, int]] | None:
    """The packing with a sequence less, or None: the emptiest one's pieces go where others have waste.

    That sequence and `others`, those of the most lengths, are opened and their
    pieces pooled. The sequences with waste, the most first, are completed
    anew from their own pieces and the pool, around the largest of both, if that
    leaves less waste; so the waste gathers in the pool, until that fits into a
    sequence less than were opened. A sequence has a token of waste at least, so
    `capacity` of them do, at any corpus size; at most `most` are looked at.
    """
    left: Counter[Filling] = Counter()
    for way, times in plan:
        left[way] += times
    size = lambda way: sum(x * m for x, m in way)
    opened = [min(left, key=lambda way: (size(way), way))]
    left[opened[0]] -= 1
    opened += [way for way in heapq.nsmallest(others + 1, left, key=lambda way: (-len(way), way)) if left[way]][:others]
    left.subtract(opened[1:])
    pool: Counter[int] = Counter()
    for way in opened:
        pool.update(dict(way))
    over = sum(map(size, opened)) - (len(opened) - 1) * capacity
    turns = (way for way in sorted(left, key=lambda way: (size(way), way)) if size(way) < capacity for _ in range(left[way]))
    stuck = None
    for way in itertools.islice(turns, most):
        if over <= 0:
            packed = best_fit(pool, capacity)
            if sum(n for _, n in packed) < len(opened):
                break
        if way == stuck:
            continue
        both = pool + Counter(dict(way))
        x = max(both)
        rest = both - Counter([x])
        found = next(fillings(rest, sorted(rest), capacity - x, capacity - size(way) - 1), None)
        if found is None:
            stuck = way
            continue
        whole = Counter(dict(found[1])) + Counter([x])
        pool = both - whole
        over -= capacity - size(way) - found[0]
        left[way] -= 1
        left[tuple(sorted(whole.items(), reverse=True))] += 1
    packed = best_fit(pool, capacity)
    if over <= 0 and sum(n for _, n in packed) >= len(opened):
        packed = search(pool, capacity, len(opened) - 1, SEARCHED) or packed
    if sum(n for _, n in packed) >= len(opened):
        return None
    for way, times in packed:
        left[way] += times
    return [(way, times) for way, times in left.items() if times]


def taken(left: Mapping[int, int], ways: Iterable[tuple[Filling, int]]) -> tuple[dict[int, int], list[tuple[Filling, int]]]:
    """(pieces left, fillings) after fillings are used so often, without the pieces that there are no more."""
    left, plan = dict(left), []
    for way, times in ways:
        while times and (way := tuple((x, min(m, left[x])) for x, m in way if left.get(x))):
            k = min(times, *(left[x] // m for x, m in way))
            for x, m in way:
                left[x] -= m * k
            plan.append((way, k))
            times -= k
    return {x: n for x, n in left.items() if n}, plan


def whole(counts: Mapping[int, int], capacity: int, goal: int, nodes: int, seed: int, known: list[Filling], parts: list[tuple[Filling, float]] | None = None) -> tuple[list[tuple[Filling, int]] | None, bool]:
    """(a packing into at most goal sequences, or None; whether None says that there is none), entering at most so many nodes.

    At each node the packing in parts of sequences gives a bound, by which it is
    left, or fillings to take: all that it uses once or more, as often as whole,
    and some of the rest. When these have led to nothing, every filling around
    the largest piece is tried, so that all packings are seen in the end. The first
    node takes `parts` if they are given.
    """
    rng, total = random.Random(seed), lambda plan: sum(n for _, n in plan)

    def finished(left: Mapping[int, int], goal: int) -> list[tuple[Filling, int]] | None:
        plan = best_fit(left, capacity)
        while goal < total(plan) <= goal + 3:
            fewer = gathered(plan, capacity, OPENED[0])
            if fewer is None:
                return None
            plan = fewer
        return plan if total(plan) <= goal else None

    def branches(left: dict[int, int], goal: int, parts: list[tuple[Filling, float]]) -> Iterator[list[tuple[Filling, int]]]:
        floors = [(way, int(v + 1e-4)) for way, v in parts if v + 1e-4 >= 1]
        rest = sorted(((v % 1 + rng.uniform(0, 0.1 if seed else 0), way) for way, v in parts if (v + 1e-4) % 1 > 2e-4), reverse=True)
        # the longest lengths first: what is left is the more alike, and fits the better
        for least, most in ((0.5, max(1, goal // (8 if seed else 4))), (0.75, max(1, goal // 16)), (0, 1)):
            left_over, more = taken(left, floors)[0], []
            for _, way in sorted((r for r in rest if r[0] >= least), key=lambda r: (-r[1][0][0], -r[0])) if least else rest:
                if len(more) < most and all(left_over.get(x, 0) >= m for x, m in way):
                    left_over = taken(left_over, [(way, 1)])[0]
                    more.append((way, 1))
            if floors or more:
                yield floors + more
        for _, way in rest[1:4]:
            yield [*floors, (way, 1)]
        x, others = max(left), dict(left)
        others[x] -= 1
        others = {y: n for y, n in others.items() if n}
        for _, way in fillings(others, sorted(others), capacity - x, goal * capacity - sum(y * n for y, n in left.items()), None):
            yield [(tuple((Counter(dict(way)) + Counter([x])).items()), 1)]

    def entered(left: dict[int, int], goal: int) -> list[tuple[Filling, int]] | Iterator:
        """The rest of the packing, or branches to look at."""
        if goal < bound(left, capacity):
            return iter(())
        found = finished(left, goal)
        if found is not None:
            return found
        if parts and len(path) == 1:
            return branches(left, goal, parts)
        lower, part, made = relaxed(left, capacity, goal, known, seed)
        known[:] = dict.fromkeys(itertools.chain(known, made))
        return branches(left, goal, part) if lower <= goal else iter(())

    seen, path = 0, [(dict(counts), goal, [])]
    levels: list[Iterator] = []
    while True:
        left, goal, plan = path[-1]
        found = entered(left, goal)
        seen += 1
        if isinstance(found, list):
            return [*itertools.chain.from_iterable(plan for *_, plan in path), *found], False
        levels.append(found)
        while (ways := next(levels[-1], None)) is None:
            levels.pop()
            path.pop()
            if not levels:
                return None, True
        if seen >= nodes:
            return None, False
        left, goal, _ = path[-1]
        rest, plan = taken(left, ways)
        path.append((rest, goal - total(plan), plan))


def plan_sequences(counts: Mapping[int, int], capacity: int, nodes: int = 64) -> list[tuple[Filling, int]]:
    """Fillings with how many sequences each makes, as few sequences as there can be.

    Best fit is the incumbent. While it is over the bound, single sequences are
    completed anew to empty one (gathered(), ROUNDS times at most). Where that
    doesn't meet the bound, the packing in parts of sequences (relaxed()) gives
    a higher one and whole packings near it are searched for (whole()), in `nodes`
    nodes and then in other orders, every second time in twice as many, every
    fourth in four times, and so on, until one meets the bound or all were seen.

    The search has no limit. The work depends on how many lengths there are, at
    most capacity, and not on how many pieces.
    """
    total = lambda plan: sum(n for _, n in plan)
    fewest, best = bound(counts, capacity), best_fit(counts, capacity)
    for _ in range(ROUNDS):
        fewer = next(filter(None, (gathered(best, capacity, n) for n in OPENED)), None) if total(best) > fewest else None
        if fewer is None:
            break
        best = fewer
    known, parts = [way for way, _ in best], []
    if total(best) > fewest:
        lower, parts, known = relaxed(counts, capacity, None, known)
        fewest = max(fewest, lower)
    for seed in itertools.count():
        limit = nodes * (seed + 1 & -seed - 1)
        for goal in dict.fromkeys((fewest, total(best) - 1)):
            if total(best) > max(goal, fewest):
                found, none = whole(counts, capacity, goal, limit, seed, known, parts if not seed else None)
                best = found or best
                fewest = goal + 1 if none else fewest
        if total(best) <= fewest:
            break
        logging.getLogger(__name__).info("%d sequences after a search of %d nodes, %d over the bound", total(best), limit, total(best) - fewest)
    logging.getLogger(__name__).info("%d sequences, the fewest there can be", total(best))
    return best


def pack(pieces: DataFrame, capacity: int = 4096, spread_n: int = SPREAD) -> DataFrame:
    """Add sequence_id and offset to pieces: a packing into as few sequences as there can be.

    Pieces of one length are alike, so the plan needs only how many there are of
    each length: at most capacity rows reach the driver, at any corpus size. The
    pieces then get numbers within their length, and the plan says which numbers
    of a length go where. Offsets are gapless from 0 in every sequence.

    Ties and repeated rows get numbers in any order; an empty table gives none.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_sequences(counts, capacity)
    used = dict.fromkeys(counts, 0)
    slots, base = [], 0
    for filling, times in plan:
        offset = 0
        for x, m in filling:
            slots.append((x, used[x], base, m, offset))
            used[x] += m * times
            offset += m * x
        base += times
    slots.sort()
    shift = 1 << 44
    table = np.array(slots, dtype=np.int64).reshape(-1, 5)
    begins = table[:, 0] * shift + table[:, 1]
    names = list(pieces.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_number"))
            slot = table[np.searchsorted(begins, length * shift + number, "right") - 1] if len(number) else table[:0]
            nth, each = number - slot[:, 1], np.maximum(slot[:, 3], 1)
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(slot[:, 2] + nth // each), pa.array(slot[:, 4] + nth % each * length)], names=[*names, "sequence_id", "offset"])

    dealt = pieces.withColumn("_sub", spread(F.concat_ws(":", "doc_id", "piece"), spread_n))
    numbered = positions(dealt, "length", ["_sub"], ["doc_id", "piece"], "_number").select(*pieces.columns, "_number")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return numbered.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(spool(tokenized(docs, tokenizer, capacity, end, id_col, text_col)), capacity)
