"""Token counts of whole texts by a deterministic finite-state transducer compiled from a BPE model's pieces and scores.

Encoding by merges has a local test: a row of pieces is the encoding of its text exactly if each two neighbours are the
encoding of what they spell. Reading from the left, the last piece of every prefix is therefore the one piece that ends
there, begins where a shorter prefix ended, and agrees with that prefix's own last piece. A *state* of the machine holds
what later characters can still ask for: the undecided ends of the text read so far (those that begin some longer piece),
each with the piece before it and how many tokens fewer had been counted there. A *transition* reads one character and is
annotated with the tokens it emits; where a longer piece takes back pieces counted before, that number is zero or negative.
States and transitions are made when a text first needs them, by merging at most two pieces; the tokenizer's library is
not called (it only reads the model file). The table is emptied at TRANSITIONS entries, which bounds memory.

Between two characters that no piece holds side by side no merge can happen: a *cut*, after which the machine is in a state
that does not depend on what came before. Of a chunk with unknown left context, only the parts before its first and after
its last cut depend on the context. Its state map is (head, tokens between, tail); maps of neighbours compose
associatively, so chunks of a text are counted anywhere, in any order, and composed pairwise, as a parallel prefix scan does.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from types import ModuleType
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, table, text_of

#: Code points in a chunk.
CHUNK = 1 << 14
#: Transitions kept at most.
TRANSITIONS = 3 << 18
LIMIT = 4096


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Map(NamedTuple):
    """What a chunk does: ``cut`` false: it is one open piece of text, in head."""

    cut: bool
    head: str
    count: int
    tail: str


class State(dict):
    """Transitions by character: (next state, tokens emitted). A missing one is compiled.

    ``last``: the piece that ends here ("" at a start or a cut); ``ends``: (undecided text, piece before it, tokens fewer).
    """

    __slots__ = ("machine", "last", "ends")

    def __init__(self, machine: Transducer, last: str, ends: tuple) -> None:
        self.machine, self.last, self.ends = machine, last, ends

    def __missing__(self, c: str) -> tuple[State, int]:
        found = self.machine.transition(self, c)
        self[c] = found
        return found


class Transducer:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
        # A character has no score to be merged by; among equal scores the leftmost pair is merged first.
        pieces = {model.id_to_piece(i).replace("▁", " "): -model.get_score(i) for i in range(model.get_piece_size()) if not special(i)}
        self.pieces = pieces
        self.begins = {p[:k] for p in pieces for k in range(1, len(p))}
        self.beside = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.agreed: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.held = 0
        self.start = self.state("", ())

    def state(self, last: str, ends: tuple) -> State:
        found = self.states.get((last, ends))
        if found is None:
            found = self.states[last, ends] = State(self, last, ends)
        return found

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, pair by pair: the best score first, the leftmost among equals."""
        none, score = float("inf"), self.pieces.get
        parts = list(text)
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := min(scores)) < none:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            for k in (at - 1, at):
                if 0 <= k < len(scores):
                    scores[k] = score(parts[k] + parts[k + 1], none)
        return parts

    def agree(self, before: str, piece: str) -> bool:
        """Whether both pieces come out of what they spell."""
        key = (before, piece)
        found = self.agreed.get(key)
        if found is None:
            if len(self.agreed) >= TRANSITIONS:
                self.agreed.clear()
            found = self.agreed[key] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return found

    def transition(self, state: State, c: str) -> tuple[State, int]:
        self.held += 1
        if self.held > TRANSITIONS:
            self.reset()
        if c not in self.pieces:  # bytes of its own, which join nothing
            return self.start, len(c.encode())
        if state.last and state.last[-1] + c not in self.beside:
            return self.start[c]
        ends = [(text + c, before, fewer) for text, before, fewer in state.ends]
        ends.append((c, state.last, 0))
        piece, fewer = next((text, fewer) for text, before, fewer in ends if text in self.pieces and self.agree(before, text))
        emitted = 1 - fewer
        open_ = tuple((text, before, fewer + emitted) for text, before, fewer in ends if text in self.begins)
        return self.state(piece, open_), emitted

    def count(self, text: str) -> int:
        """Tokens of a text as it stands: no space is put before it."""
        state, total = self.start, 0
        for c in text:
            state, n = state[c]
            total += n
        return total

    def map(self, text: str) -> Map:
        near, last = self.beside, len(text) - 1
        first = next((k for k in range(1, last + 1) if text[k - 1 : k + 1] not in near), 0)
        if not first:
            return Map(False, text, 0, "")
        end = next(k for k in range(last, 0, -1) if text[k - 1 : k + 1] not in near)
        return Map(True, text[:first], self.count(text[first:end]), text[end:])

    def compose(self, a: Map, b: Map) -> Map:
        seam = self.map((a.tail if a.cut else a.head) + b.head)
        if a.cut and b.cut:
            return Map(True, a.head, a.count + self.total(seam) + b.count, b.tail)
        if a.cut:
            return Map(True, a.head, a.count + self.count(seam.head) + seam.count, seam.tail) if seam.cut else Map(True, a.head, a.count, seam.head)
        if b.cut:
            return Map(True, seam.head, seam.count + self.count(seam.tail) + b.count, b.tail)
        return seam

    def scan(self, maps: list[Map]) -> Map:
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0]

    def total(self, m: Map) -> int:
        return self.count(m.head) + m.count + self.count(m.tail)


def machine_of(path: str) -> Transducer:
    """The machine of this worker process: workers outlive tasks, so what one task has compiled serves the next ones.

    It is held in a module of its own, as the globals of functions that travel by value are made anew for each task.
    """
    kept = sys.modules.setdefault("_token_machines", ModuleType("_token_machines"))
    if not hasattr(kept, path):
        setattr(kept, path, Transducer(path))
    return getattr(kept, path)


MAP = "cut boolean, head string, count long, tail string"


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    Null or empty text: 0 tokens; repeated rows stay, each counted; an empty table gives no rows. Very long texts are
    counted in chunks of ``chunk`` code points, none is cut off. Only doc_id and text are read: other columns may have any names.
    """
    path = model or default_model()
    kind = docs.schema["doc_id"].dataType.simpleString()
    # The model starts a text with one space. A literal U+2581 is the model's own sign for a space.
    text = F.when(F.col("text") != "", F.concat(F.lit(" "), F.translate("text", "▁", " "))).otherwise("")
    rows = docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), text.alias("t"))
    parts = F.when(F.length("t") <= chunk, F.array("t")).otherwise(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", parts.alias("parts"))
    rows = rows.select("doc_id", "n_bytes", "row", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part"))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(path)
        for batch in sliced(batches):
            out = []
            for alone, part in zip(batch.column(3), batch.column(5), strict=True):
                out.append(Map(True, "", machine.count(part.as_py()), "") if alone.as_py() == 1 else machine.map(part.as_py()))
            cols = [*zip(*out, strict=True)] or [()] * 4
            types = [pa.bool_(), pa.string(), pa.int64(), pa.string()]
            own = [pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *own], [*batch.schema.names[:5], "cut", "head", "count", "tail"])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(path)
        for batch in sliced(batches):
            found = [machine.total(machine.scan([Map(x["cut"], x["head"], x["count"], x["tail"]) for x in xs])) for xs in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    done = table(rows.mapInArrow(maps, f"doc_id {kind}, n_bytes long, row long, n int, k int, {MAP}"), "token-maps")
    whole = done.where("n = 1").select("doc_id", "n_bytes", F.col("count").alias("n_tokens"))
    parts = done.where("n > 1").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("k", "cut", "head", "count", "tail"))).alias("maps"))
    parts = parts.select("doc_id", "n_bytes", "maps").mapInArrow(composed, f"doc_id {kind}, n_bytes long, n_tokens long")
    return whole.unionByName(parts).withColumn("over_limit", F.col("n_tokens") > limit)
