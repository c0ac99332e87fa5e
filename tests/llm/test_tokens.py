import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitescope.llm import tokens

from ..conftest import DATA


@pytest.fixture(scope="module")
def machine():
    return tokens.Transducer(tokens.default_model())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())


def counts(docs, model):
    return sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(model.encode(r["text"] or "")), n > 4096) for r in docs.collect()), key=str)


@pytest.mark.parametrize("chunk", [tokens.CHUNK, 7])
def test_documents(spark, odd, none, chunk, library):
    small = odd if chunk > 100 else odd.where("doc_id <> 3")
    assert sorted((tuple(r) for r in tokens.count_tokens(small, chunk=chunk).collect()), key=str) == counts(small, library)
    assert tokens.count_tokens(none).count() == 0


def test_table(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert sorted((tuple(r) for r in tokens.count_tokens(docs).collect()), key=str) == counts(docs, library)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" \n\t▁aeiThe1.")), max_size=60), st.lists(st.integers(0, 60), max_size=6))
def test_maps_compose(machine, library, text, cuts):
    want = len(library.encode(text))
    own = (" " + text if text else "").replace("▁", " ")
    assert machine.count(own) == want
    edges = [0, *sorted(min(c, len(own)) for c in cuts), len(own)]
    maps = [machine.map(own[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    assert machine.total(machine.scan(maps)) == want


def test_table_of_transitions_is_bounded(machine, library, monkeypatch):
    monkeypatch.setattr(tokens, "TRANSITIONS", 3)
    assert machine.count(" some words that fill the table again and again") == len(library.encode("some words that fill the table again and again"))


def test_random_pieces(machine, library):
    """Pieces side by side, words without spaces and scripts without words: where merges reach far."""
    import random

    rng = random.Random(7)
    pieces = sorted(machine.pieces)
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        assert machine.count(" " + text) == len(library.encode(text)), text


def test_transitions_take_back_tokens(machine):
    """A longer piece replaces shorter ones: the transitions' outputs add up to the count at every prefix."""
    state, total, seen = machine.start, 0, []
    for c in " international":
        state, n = state[c]
        total += n
        seen.append(total)
    assert seen[-1] == machine.count(" international") and min(b - a for a, b in zip(seen, seen[1:], strict=False)) < 0
    assert seen == [machine.count(" international"[: k + 1]) for k in range(len(seen))]
