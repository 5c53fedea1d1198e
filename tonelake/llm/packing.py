"""Sum-of-squares packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import raw, small_batches

#: Words whose ids a task remembers; they are forgotten together beyond this many.
WORDS_HELD = 500_000
#: The pre-tokens of byte-level BPE files, written so that the matcher never goes back.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Each packing task gets about this many open pieces, so that its bins close almost full.
ITEMS_PER_TASK = 24_000

_IDS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(path: str, ranks: str | None = None):
    """text -> ids of a byte-level BPE file, remembering the ids of repeated words.

    Byte-level BPE never merges across pre-tokens, and a pre-token starts at every space that a
    non-space follows. So ids per space-led word, joined, are the text's ids. Texts with a space
    before other white space or at their end are encoded in one go. `ranks` is the same vocabulary
    as ranks, which merges a new word several times faster; without it, and for texts that spell a
    special token, the file's own tokenizer is asked.
    """
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(path)
    special = [t.content for t in bpe.get_added_tokens_decoder().values()]
    uneven = re.compile(r" (?=\s|\Z)").search

    def own(text: str) -> list[int]:
        return bpe.encode(text, add_special_tokens=False).ids

    merge = own
    if ranks:
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        merge = tiktoken.Encoding(
            "ranks", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={}
        ).encode_ordinary

    class Ids(dict):
        def __missing__(self, word: str) -> bytes:
            if len(self) >= WORDS_HELD:
                self.clear()
            ids = self[word] = np.array(merge(" " + word), "<u4").tobytes()
            return ids

    known = Ids()

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(own(text), "<u4")
        if uneven(text):
            return np.array(merge(text), "<u4")
        first, *words = text.split(" ")
        head = np.array(merge(first), "<u4").tobytes()
        return np.frombuffer(head + b"".join(map(known.__getitem__, words)), "<u4")

    return encode


def tokenised(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, size: int = 2048, end_id: int = 0
) -> DataFrame:
    """Every document as pieces of at most `size` ids, its end id included.

    A document that is too long is cut into whole pieces from its end, so only its first piece is
    shorter. Null text is an empty document: one piece that holds the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for batch in small_batches(batches, "text", 2_000_000):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text"))):
                ids = np.append(encode(text.decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4")
                first = len(ids) % size or size
                cuts = [0, *range(first, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cols[0], pa.int64()),
                    pa.array(cols[1], pa.int32()),
                    *(pa.array(c, pa.int64()) for c in cols[2:]),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _IDS)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Place lengths one by one where the squared counts of open bins per gap become smallest.

    Returns bin and offset of each length, and the number of bins. `open_` counts open bins by the
    room they have left. Putting s into a bin of gap g takes one bin from g and adds one to g - s,
    so the sum changes by 2 (n[g-s] - n[g]) + 2, without the gain of a bin that closes. Ties go to
    the fullest bin.
    """
    open_ = np.zeros(size + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins = 0
    for i, s in enumerate(map(int, lengths)):
        change = 2 * (open_[: size - s + 1] - open_[s:]) + 2
        change[0] = 1 - 2 * open_[s]
        change[open_[s:] == 0] = np.iinfo(np.int64).max
        if s < size:
            change[size - s] = 2 * open_[size - s] + 1
        else:
            change[0] = 0
        left = int(np.argmin(change))
        gap = left + s
        if gap == size:
            home, bins = bins, bins + 1
        else:
            home = stacks[gap].pop()
            open_[gap] -= 1
        where[i], offset[i] = home, size - gap
        if left:
            stacks[left].append(home)
            open_[left] += 1
    return where, offset, bins


def best_order(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, from the order of placing that needs the fewest bins.

    Orders tried: longest first; long ones first, then the others as they come; as they come.
    """
    down = np.argsort(-lengths, kind="stable")
    long = lengths[down] >= size // 2
    orders = (down, np.concatenate([down[long], np.sort(down[~long])]), np.arange(len(lengths)))
    packed = [sum_of_squares(lengths[o], size) for o in orders]
    order, (where, offset, _) = min(zip(orders, packed), key=lambda x: x[1][2])
    back = np.argsort(order)
    return where[back], offset[back]


def pack(pieces: DataFrame, size: int = 2048, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """Give each piece a sequence and an offset in it.

    Full pieces are sequences of their own and meet no other row. The rest are dealt evenly, by a
    hash of their content, to as many tasks as their number asks for; each task packs its own
    in the best of three orders, so nothing depends on a key of the data. Equal rows get equal hashes and may
    land together, which changes nothing. Sequence ids are the task's number and the bin's, and a
    full piece's are numbered after them, unique in the result.
    """
    full = pieces.filter(F.col("length") == size)
    rest = pieces.filter(F.col("length") < size)
    tasks = max(1, -(-rest.count() // items_per_task))
    schema = pieces.schema.simpleString()[7:-1] + ",sequence_id:long,offset:long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by(
            [("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")]
        )
        where, offset = best_order(rows.column("length").to_numpy(), size)
        base = TaskContext.get().partitionId() << 33
        rows = rows.append_column("sequence_id", pa.array(base + 2 * where))
        rows = rows.append_column("offset", pa.array(offset))
        yield from rows.to_batches()

    packed = rest.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32")).mapInArrow(run, schema)
    alone = full.withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1)
    return packed.unionByName(alone.withColumn("offset", F.lit(0).cast("long")))
