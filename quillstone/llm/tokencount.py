"""Token counts by a compiled, weighted transducer.

The tokenizer is compiled, as far as texts ask for it, into a deterministic transducer
over bytes. Its state after some bytes of a piece (what the pre-tokenizer never merges
over) is what the rest can still depend on: the longest end of these bytes that a token
may go on from, and for each shorter such end the last token before it and the tokens
emitted up to there. An arc's weight is the change in the number of tokens emitted. The
next state follows from the rule that a sequence of tokens is the tokenizer's own if and
only if each neighbouring pair is: of the tokens that end with the new byte one alone
goes with the last token before it. States and arcs are compiled on first use, up to a
bound; beyond it the same step is taken without keeping it, so counts are exact.

The start state S is synchronising: it is reached between a character that is no white
space and a white-space one, where the tokenizer always cuts, whatever came before. A
path from S to S that has been read before is kept as one composite arc.

A chunk of text is a state map (head, count, tail): what must be read before S is
reached first, the weight emitted from there to the last S, and the state it ends
in, which is S with `tail` read. Maps form a monoid. Every text is cut into chunks, which
Spark deals to tasks; their maps, a few numbers and ends of words each, are composed per
text by a parallel prefix scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import bpe
from quillstone.llm.common import light, resident, small_batches

_SYNC = re.compile(r"(?<=\S)(?=\s)")
#: Characters whose classes have been the same in all versions of Unicode that libraries use: ASCII to Cyrillic, kana, Han, Hangul.
_STABLE = re.compile("[\u0000-\u052f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
_PIECES = regex.compile(bpe.PATTERN)
#: Code points of a chunk.
CHUNK = 1 << 16


@dataclass(frozen=True)
class StateMap:
    """tail None: S is not reached within the chunk, and head is the whole of it."""

    head: str
    count: int = 0
    tail: str | None = None


class ByteMachine:
    """States and arcs within a piece. one(piece) -> ids is the tokenizer's rule for a single piece."""

    def __init__(self, ranks: dict[bytes, int], one, most: int):
        self.ranks, self.one, self.most = ranks, one, most
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.begins = {b[:k] for b in ranks for k in range(len(b) + 1)}
        self.compiled = 0
        start = (b"", (None,), (0,))
        self.states, self.number, self.arcs, self.pairs = [start], {start: 0}, {}, {}

    def _go_together(self, a: int, b: int) -> bool:
        got = self.pairs.get(a << 32 | b)
        if got is None:
            got = self.one(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.pairs) < self.most:
                self.pairs[a << 32 | b] = got
        return got

    def _step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state after one more byte, and the arc's weight."""
        end, last, emitted = state
        end += bytes([byte])
        for p in range(len(end) - 1, -1, -1):
            token = self.ranks.get(end[p:])
            if token is not None and (last[p] is None or self._go_together(last[p], token)):
                break
        else:
            raise ValueError("no token goes with this byte")
        n = emitted[p] + 1
        weight, last, emitted = n - emitted[-1], (*last, token), (*emitted, n)
        keep = 0
        while end[keep:] not in self.begins:
            keep += 1
        return (end[keep:], last[keep:], tuple([x - n for x in emitted[keep:]])), weight

    def read(self, piece: bytes) -> int:
        """Tokens of a whole piece: the weight of its path from S. With a full table, new states are passed through unnumbered."""
        arcs, state, here, n = self.arcs, 0, None, 0
        for byte in piece:
            if state is not None:
                arc = arcs.get(state << 8 | byte)
                if arc is not None:
                    state = arc >> 16
                    n += (arc & 65535) - 32768
                    continue
                here = self.states[state]
            here, weight = self._step(here, byte)
            self.compiled += 1
            n += weight
            number = self.number.get(here)
            if number is None and len(self.states) < self.most:
                number = self.number[here] = len(self.states)
                self.states.append(here)
            if number is not None and state is not None and len(arcs) < 4 * self.most:
                arcs[state << 8 | byte] = number << 16 | weight + 32768
            state = number
        return n


class CountTransducer:
    """weight(stretch): tokens emitted on the path from S to S of that label."""

    def __init__(self, path: str, arcs: int = 100_000, states: int = 150_000):
        self.encoder = bpe.PieceEncoder(path)
        self.most, self.led, self.bare, self.n_states = arcs, {}, {}, states

    @cached_property
    def machine(self) -> ByteMachine:
        return ByteMachine(self.encoder.fast._mergeable_ranks, self.encoder.fast._encode_single_piece, self.n_states)

    def _emit(self, stretch: str) -> int:
        """By the machine, piece by piece; what holds an added token or an odd character by the library."""
        if stretch.removeprefix(" ").isalpha() and (stretch.isascii() or max(stretch) < "\u0530") and self.encoder.one is not None:
            return self.machine.read(stretch.encode())  # the pre-tokenizer does not cut it
        if any(t in stretch for t in self.encoder.added) or _STABLE.fullmatch(stretch) is None:
            return len(self.encoder.ids(stretch))
        return sum(self.machine.read(p.encode()) for p in _PIECES.findall(stretch))

    def weight(self, stretch: str) -> int:
        if not stretch:
            return 0
        got = self.bare.get(stretch)
        if got is None:
            got = self._emit(stretch)
            if len(self.bare) < self.most and len(stretch) < bpe.LONGEST:
                self.bare[stretch] = got
        return got

    def run(self, text: str) -> int:
        """Weight of the path that reads text, which starts and ends at S (or at an end of the whole)."""
        if not text:
            return 0
        if bpe._TIGHT.search(text):
            return sum(map(self.weight, bpe._RUNS.findall(text)))
        first, *rest = text.split(" ")
        led, most = self.led, self.most
        weights = list(map(led.get, rest))
        if None in weights:
            for i, p in enumerate(rest):
                if weights[i] is None:
                    weights[i] = got = self._emit(" " + p)
                    if len(led) < most and len(p) < bpe.LONGEST:
                        led[p] = got
        return self.weight(first) + sum(weights)

    def map_of(self, chunk: str) -> StateMap:
        if (first := _SYNC.search(chunk)) is None:
            return StateMap(chunk)
        a, b = first.start(), len(chunk)
        while not (b < len(chunk) and chunk[b].isspace() and not chunk[b - 1].isspace()):
            b -= 1  # a is such a place, so this ends
        return StateMap(chunk[:a], self.run(chunk[a:b]), chunk[b:])

    def compose(self, x: StateMap, y: StateMap) -> StateMap:
        """x, then y. The seam may itself hold a synchronising place."""
        if x.tail is None and y.tail is None:
            return self.map_of(x.head + y.head)
        if x.tail is None:
            seam = self.map_of(x.head + y.head)
            if seam.tail is None:
                return StateMap(seam.head, y.count, y.tail)
            return StateMap(seam.head, seam.count + self.run(seam.tail) + y.count, y.tail)
        if y.tail is None:
            seam = self.map_of(x.tail + y.head)
            if seam.tail is None:
                return StateMap(x.head, x.count, seam.head)
            return StateMap(x.head, x.count + self.run(seam.head) + seam.count, seam.tail)
        return StateMap(x.head, x.count + self.run(x.tail + y.head) + y.count, y.tail)

    def prefixes(self, maps: list[StateMap]) -> list[StateMap]:
        """All prefix compositions by doubling: log2 rounds, each of independent steps."""
        out, step = list(maps), 1
        while step < len(out):
            out = [m if i < step else self.compose(out[i - step], m) for i, m in enumerate(out)]
            step *= 2
        return out

    def total(self, m: StateMap) -> int:
        """Weight of the whole text that m maps, from its start to its end."""
        return self.run(m.head) + m.count + (self.run(m.tail) if m.tail else 0)

    def whole(self, maps: list[StateMap]) -> StateMap:
        """The composition of all, in order, by pairs: as many rounds as the scan has."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        return self.total(self.whole([self.map_of(text[i : i + chunk]) for i in range(0, len(text), chunk)] or [StateMap("")]))


def _transducer(path: str) -> CountTransducer:
    return resident(("transducer", path), lambda: CountTransducer(path))


def _library(path: str):
    """Counts of whole texts, for files that are no byte-level BPE."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    library = _transducer(path).encoder.library
    return lambda t: len(library.encode(t, add_special_tokens=False).ids)


def _maps(chunks: DataFrame, path: str, kind: str) -> DataFrame:
    """The state map of each chunk (rid, k, chunk); of a chunk that is its whole text the count alone."""

    def run(batches):
        machine = _transducer(path)
        for batch in light(batches, keeping=True):
            out = []
            for rid, k, n, chunk in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3))):
                m = machine.map_of(chunk or "")
                out.append((rid, k, "", machine.total(m), "") if n <= 1 else (rid, k, m.head, m.count, m.tail))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string()), batch.column(4), batch.column(5)], names=["rid", "k", "head", "count", "tail", "id", "n_bytes"]
            )

    return chunks.mapInArrow(run, f"rid long, k int, head string, count long, tail string, id {kind}, n_bytes long")


def _composed(maps: DataFrame, path: str, kind: str) -> DataFrame:
    """One row per rid. maps: of each rid together, in order of k."""

    def run(batches):
        machine, now, held = _transducer(path), None, []
        for batch in light(batches, keeping=True):
            out = []
            for rid, _, head, count, tail, i, n_bytes in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if held and rid != now[0]:
                    out.append((*now[1:], machine.total(machine.whole(held))))
                    held = []
                now = (rid, i, n_bytes)
                held.append(StateMap(head, count, tail))
            schema = batch.schema.field(5).type
            yield _counted(out, schema)
        if held:
            yield _counted([(*now[1:], machine.total(machine.whole(held)))], schema)

    return maps.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")


def _counted(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, n_bytes, n_tokens = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty (0 bytes, 0 tokens); null and repeated ids stay as they are;
    other columns of docs are not read. Byte-level BPE files run as a transducer, chunk code
    points of a text at a time; .model files and other .json files are counted by their
    library on the whole text. Rows move by their number alone, with the maps of chunks.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    if tokenizer_path.endswith(".model") or not bpe.PieceEncoder(tokenizer_path).pieces_are_exact:

        def count(batches):
            n_of = _library(tokenizer_path)
            for batch in light(batches, keeping=True):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([n_of(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["id", "n_bytes", "n_tokens"])

        out = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    else:
        cut = F.expr(f"if(char_length(text) <= {chunk}, array(text), regexp_extract_all(text, r'(?s).{{1,{chunk}}}', 0))")
        chunks = rows.select(F.monotonically_increasing_id().alias("rid"), "id", "n_bytes", cut.alias("cut")).select("rid", F.size("cut").alias("n"), "id", "n_bytes", F.posexplode("cut").alias("k", "chunk"))
        maps = _maps(chunks.select("rid", "k", "n", "chunk", "id", "n_bytes"), tokenizer_path, kind)
        out = _composed(maps.repartition("rid").sortWithinPartitions("rid", "k"), tokenizer_path, kind)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
