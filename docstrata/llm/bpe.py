"""BPE encoding as a streaming transducer of bounded lookahead, and incremental decoding.

Whether a merge crosses a place in the text depends on a bounded number of bytes after that place
only. The bound follows from the merge list (see sufficient_lookahead), so tokens that end that far
before the end of what was read, or with their piece, are final: they are emitted and forgotten.
The transducers of many pieces step together: each reads one window of its piece, the windows are merged
in numpy, one merge of each a round, and what is stable is emitted. A window is of fixed size, and
texts are read block by block: a block ends where no piece can cross, before white space or between letters,
digits and other characters. So beside a row's text and ids, memory grows with the longest piece only, not with
the text, whatever its language or format.
Decoding feeds token bytes to an incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .textbatch import small_batches

#: Fixed value: the pattern that splits text before byte-level merges apply.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the Unicode property has it; \s of this regex library means more.
UNICODE_SPACE = r"\p{White_Space}"
#: Characters of a text that are read at once, and those whose pieces step together.
CHUNK_CHARS = 1 << 16
STEP_CHARS = 1 << 20
#: Rows, and bytes of them, encoded or decoded before they are passed on.
BATCH_ROWS = 1024
BATCH_BYTES = 1 << 24
#: Bytes that a window holds besides the lookahead.
WINDOW_BYTES = 4096
NONE = 1 << 30


def _byte_names() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, names = spec["model"]["vocab"], _byte_names()
        of = {c: b for b, c in enumerate(names)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for c in names], np.int64)
        self.pairs = [(vocab[a], vocab[b]) for a, b in merges]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        keys = np.array([a << 20 | b for a, b in self.pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        # of a rule whose token begins or ends a pair of lower rank, one merge may forestall the next
        of_token = np.full(size, NONE, np.int64)
        for r, (a, b) in enumerate(self.pairs):
            of_token[a], of_token[b] = min(of_token[a], r), min(of_token[b], r)
        self.one_by_one = of_token[self.made] <= np.arange(len(self.made))
        self.split = regex.compile(PATTERN.replace(r"[^\s", rf"[^{UNICODE_SPACE}").replace(r"\s", UNICODE_SPACE).replace(r"\S", r"\P{White_Space}"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lookahead = sufficient_lookahead(self.pairs, self.made.tolist(), self.lengths.tolist())

    # encoding

    def encode(self, text: str) -> Iterator[bytes]:
        """Blocks of int32 ids, each emitted as soon as it is final."""
        for block in self.blocks(text):
            ids, _ = self.encode_blocks([block])
            yield ids.tobytes()

    def blocks(self, text: str) -> Iterator[str]:
        """Parts of text whose ends no piece crosses: special tokens, and about CHUNK_CHARS of the rest."""
        parts = self.specials.split(text) if self.specials and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield part
            elif part:
                at, reach = 0, CHUNK_CHARS
                while at < len(part):
                    end = len(part) if at + reach >= len(part) else _last_cut(part, at, at + reach)
                    if end <= at:
                        reach *= 2  # one piece so far
                        continue
                    yield part[at:end]
                    at, reach = end, CHUNK_CHARS

    def encode_blocks(self, blocks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of the blocks one after another, and how many each has. Equal words, and pieces, go through once.

        A blank after a non-blank always starts a piece, so blocks are split there and the pattern sees
        distinct words only. A block with a blank after other white space is one word, as a special token is."""
        lists = pc.split_pattern(pa.array(blocks, pa.string()), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        blank = np.fromiter((not w or w[-1].isspace() for w in words), bool, len(words))
        first = np.zeros(len(which), bool)
        first[offsets[:-1]] = True
        before_blank = ~np.r_[first[1:], True] & blank[which]
        block_of = np.repeat(np.arange(len(blocks)), np.diff(offsets))
        alone = np.zeros(len(blocks), bool)
        alone[block_of[before_blank]] = True
        alone |= np.fromiter((b in self.special for b in blocks), bool, len(blocks))

        # units: distinct words with a blank before, then what starts a block, then whole blocks
        plain = np.flatnonzero(~blank)
        joined = self.split.findall("".join([" " + words[w] for w in plain.tolist()]))
        ends = np.cumsum(np.fromiter((len(words[w]) + 1 for w in plain.tolist()), np.int64, len(plain)))
        counts = np.diff(np.r_[0, np.searchsorted(np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined))), ends, "right")])
        unit, n_words = np.zeros(len(words), np.int64), len(plain)
        unit[plain] = np.arange(n_words)
        pieces, more = [joined], []
        for w in np.flatnonzero(blank).tolist():
            unit[w] = n_words + len(more)
            more.append(self.split.findall(" " + words[w]))
        starts = n_words + len(more)
        for b, text in enumerate(blocks):
            more.append(([text] if text in self.special else self.split.findall(text)) if alone[b] else self.split.findall(words[which[offsets[b]]]))
        counts = np.r_[counts, np.fromiter(map(len, more), np.int64, len(more))]
        pieces += more
        units = unit[which]
        units[offsets[:-1]] = starts + np.arange(len(blocks))
        keep = first | ~alone[block_of]
        units, block_of = units[keep], block_of[keep]

        coded = pa.array([p for own in pieces for p in own], pa.string()).dictionary_encode()
        distinct, number = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        ids, ends = self.transduce([b"" if p in self.special else p.encode() for p in distinct])
        for at in [i for i, p in enumerate(distinct) if p in self.special]:
            ids = np.insert(ids, ends[at], self.special[distinct[at]])
            ends[at + 1 :] += 1
        of_units, unit_ends = _gather(ids, ends, number, np.r_[0, np.cumsum(counts)])
        out, block_ends = _gather(of_units, unit_ends, units, np.r_[0, np.cumsum(np.bincount(block_of, minlength=len(blocks)))])
        return out.astype(np.int32), np.diff(block_ends)

    def transduce(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of the pieces one after another, and where each one's end. In a step, every piece that isn't
        done reads a window; of a window that ends before its piece, only stable tokens are emitted."""
        room = self.lookahead + WINDOW_BYTES
        emitted: list[tuple[np.ndarray, np.ndarray]] = []
        open_, at = np.arange(len(pieces)), np.zeros(len(pieces), np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        while len(open_):
            read = np.minimum(size[open_] - at[open_], room)
            if len(open_) == len(pieces) and size.max(initial=0) <= room:
                data = b"".join(pieces)
            else:
                data = b"".join(pieces[p][a : a + n] for p, a, n in zip(open_.tolist(), at[open_].tolist(), read.tolist()))
            ids, counts = self.merge_windows(np.frombuffer(data, np.uint8), read)
            whole = at[open_] + read == size[open_]
            of = np.repeat(np.arange(len(open_)), counts)
            ends = np.cumsum(self.lengths[ids])
            ends -= np.repeat(np.cumsum(read) - read, counts)  # where each token ends in its window
            stable = whole[of] | (ends <= WINDOW_BYTES)
            emitted.append((open_[of[stable]], ids[stable]))
            np.maximum.at(read := np.where(whole, read, 0), of[stable], ends[stable])
            at[open_] += read
            open_ = open_[~whole]
        owner = np.concatenate([e[0] for e in emitted]) if emitted else np.zeros(0, np.int64)
        ids = np.concatenate([e[1] for e in emitted]) if emitted else owner
        if len(emitted) > 1:
            order = np.argsort(owner, kind="stable")
            owner, ids = owner[order], ids[order]
        return ids, np.r_[0, np.cumsum(np.bincount(owner, minlength=len(pieces)))]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the rule that merges each pair, NONE if there is none."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else np.zeros(len(key), np.int64)
        return np.where(self.keys[at] == key, self.order[at], NONE) if len(self.keys) else np.full(len(key), NONE)

    def merge_windows(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the windows of data one after another, and how many each has. In a round, each window
        applies its rule of the lowest rank: wherever it fits, or at the leftmost place only, if what
        it makes there could come before the next place."""
        tokens, window = self.byte_ids[data], np.repeat(np.arange(len(sizes)), sizes)
        last = np.ones(len(tokens), bool)
        last[:-1] = window[1:] != window[:-1]
        rank = np.full(len(tokens), NONE, np.int64)
        inner = np.flatnonzero(~last)
        rank[inner] = self.ranks(tokens[inner], tokens[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(tokens):
            starts = np.flatnonzero(np.r_[True, last[:-1]])
            best = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(tokens)])
            over = best == NONE
            if over.any():
                leave = np.repeat(over, length)
                done.append((window[leave], tokens[leave]))
                stay = ~leave
                tokens, window, last, rank = tokens[stay], window[stay], last[stay], rank[stay]
                best, length = best[~over], length[~over]
                if not len(tokens):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, length))
            follows = np.r_[False, hit[1:] == hit[:-1] + 1]
            if follows.any():  # of overlapping places, every other one from the left
                first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(hit))))
                hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            careful = self.one_by_one[rank[hit]]
            if careful.any():
                hit = hit[~careful | np.r_[True, window[hit[1:]] != window[hit[:-1]]]]
            tokens[hit] = self.made[rank[hit]]
            last[hit] = last[hit + 1]
            keep = np.ones(len(tokens), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged tokens are once the others are gone
            tokens, window, last, rank = tokens[keep], window[keep], last[keep], rank[keep]
            anew = np.concatenate([at, at[at > 0] - 1])
            rank[anew] = NONE
            anew = anew[~last[anew]]
            rank[anew] = self.ranks(tokens[anew], tokens[anew + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        window, tokens = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(window, kind="stable")
        return tokens[order], np.bincount(window, minlength=len(sizes))

    def piece(self, data: bytes) -> Iterable[int]:
        """Ids of one piece, window by window."""
        return self.transduce([data])[0].tolist()

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece, read at once."""
        return self.merge_windows(np.frombuffer(data, np.uint8), np.array([len(data)]))[0].tolist()

    # decoding

    def decode(self, ids: np.ndarray, block: int = 1 << 14) -> str:
        """Text of ids; bytes that form no character become U+FFFD, ids outside the vocabulary vanish."""
        machine, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.bytes_of)):
            ids = ids[(ids >= 0) & (ids < len(self.bytes_of))]
        for at in range(0, len(ids), block):
            out.append(machine.decode(b"".join(map(self.bytes_of.__getitem__, ids[at : at + block].tolist()))))
        out.append(machine.decode(b"", True))
        return "".join(out)


def _gather(values: np.ndarray, ends: np.ndarray, which: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs which of values (run i ends at ends[i + 1]) one after another, and where each group of runs ends."""
    size = np.diff(ends)[which]
    total = np.r_[0, np.cumsum(size)]
    return values[np.repeat(ends[which] - total[:-1], size) + np.arange(total[-1])], total[groups]


#: Between these, a piece always ends: white space after anything else, and another class after letters or digits, or
#: after other characters but the apostrophe, which may begin a piece such as 's.
_ENDS = [
    (r"\P{White_Space}", r"\p{White_Space}"),
    (r"\p{L}", r"[^\p{L}\p{White_Space}]"),
    (r"\p{N}", r"[^\p{N}\p{White_Space}]"),
    (r"[^\p{L}\p{N}\p{White_Space}']", r"[\p{L}\p{N}]"),
]
_CUT = regex.compile("(?r)" + "|".join(f"(?<={a})(?={b})" for a, b in _ENDS))


def _last_cut(text: str, start: int, end: int) -> int:
    """The last place in text[start + 1 : end] where a piece always ends, or -1."""
    found = _CUT.search(text, start + 1, end)
    return found.start() if found else -1


def sufficient_lookahead(pairs: list[tuple[int, int]], made: list[int], lengths: list[int]) -> int:
    """Bytes after a place that decide which merges cross it.

    Rule (u, v) crosses a place if v forms after it. Only a rule of lower rank whose left side is a
    token that ends where v ends, on v's right spine, can take v's end away before; whether it applies
    depends on its own right side, and so on with falling ranks. Taking the rules by rank gives
    reach(u, v) = len(v) + the largest reach of an earlier rule whose left side is on v's right spine.
    """
    right = {}
    for (_, b), token in zip(pairs, made):
        right.setdefault(token, b)
    reach: dict[int, int] = {}
    for a, b in pairs:
        most, token = 0, b
        while token is not None:
            most = max(most, reach.get(token, 0))
            token = right.get(token)
        reach[a] = max(reach.get(a, 0), lengths[b] + most)
    return max(reach.values(), default=0)


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _encoded(bpe: Bpe, batch: pa.RecordBatch) -> pa.ListArray:
    """The ids of a batch's second column, texts."""
    held, chars, rows, parts, sizes = [], 0, [], [], np.zeros(batch.num_rows, np.int64)

    def step() -> None:
        ids, counts = bpe.encode_blocks(held)
        parts.append(ids)
        np.add.at(sizes, rows, counts)

    for row, text in enumerate(batch.column(1)):
        for block in bpe.blocks(text.as_py()):
            held.append(block)
            rows.append(row)
            chars += len(block)
            if chars >= STEP_CHARS:
                step()
                held, chars, rows = [], 0, []
    if held:
        step()
    ids = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), ids)


def _decoded(bpe: Bpe, lists: pa.ListArray) -> pa.Array:
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return pa.array([bpe.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.string())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids array<int> of docs (doc_id, text). tokenizer: a path that every executor can open.

    A null text counts as empty and gives an empty array; rows are treated one by one, so repeated
    rows, null ids and an empty table need no special rule; other columns are ignored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in small_batches(batches, BATCH_ROWS, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), _encoded(bpe, batch)], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids, text of encoded (doc_id, ids); null ids give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in small_batches(batches, BATCH_ROWS, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _decoded(bpe, batch.column(1))], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(decode, "doc_id long, ids array<int>, text string")


def code_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids, text of docs (doc_id, text): what decode_documents gives for encode_documents, in one pass."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in small_batches(batches, BATCH_ROWS, BATCH_BYTES):
            lists = _encoded(bpe, batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, _decoded(bpe, lists)], ["doc_id", "ids", "text"])

    return _texts(docs).mapInArrow(both, "doc_id long, ids array<int>, text string")
