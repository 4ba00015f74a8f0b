import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from navloom.llm import pieces
from navloom.llm.queries import model_path


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def encoder():
    return pieces.MergeEncoder(model_path())


def test_odd_texts_as_the_library(encoder, library, odd_texts):
    for t in [*odd_texts, "the" * 500, " \n" * 50, *("▁ a" * n for n in range(8)), "<s></s><unk>", "ab▁▁ c"]:
        want = library.encode(t or "", add_eos=True)
        assert encoder.encode(t) == want
        assert encoder.decode(want) == library.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefgh the▁\n\t éñ漢😀.,<>0129", max_size=60))
def test_any_text_as_the_library(encoder, library, text):
    assert encoder.encode(text) == library.encode(text, add_eos=True)


def test_backtracking_equals_plain_merging(encoder):
    for chunk in ("▁unbelievably", "▁aaaaaaa", "interestingly", "▁▁▁▁▁▁▁x", "zzzzqqqq"):
        assert encoder.split(chunk) == encoder.merged(chunk)


def test_query_rows(docs_of, library, odd_texts, clashes):
    docs = docs_of(odd_texts, extra=clashes)
    rows = {r["doc_id"]: r for r in pieces.token_digests(pieces.encode_documents(docs, model_path())).collect()}
    for i, t in enumerate(odd_texts):
        ids = library.encode(t or "", add_eos=True)
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_round_trip_and_empty(docs_of, odd_texts):
    back = pieces.decode_ids(pieces.encode_documents(docs_of(odd_texts), model_path()), model_path())
    assert all(r["text"] == (odd_texts[r["doc_id"]] or "") for r in back.collect())
    assert pieces.encode_documents(docs_of([]), model_path()).count() == 0


def test_other_models_and_taken_columns_are_refused(docs_of, tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.pieces[400].type = 4
    path = str(tmp_path / "own.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    with pytest.raises(ValueError, match="user defined"):
        pieces.MergeEncoder(path)
    with pytest.raises(ValueError, match="already"):
        pieces.decode_ids(docs_of(["a"]), model_path())


def test_pieces_stay_as_merging_says(encoder):
    rng, by = random.Random(5), {}
    every = [*encoder.reach, *(p for p in encoder.scores if len(p) == 1)]
    for p in every:
        by.setdefault(p[0], []).append(p)
    n = {True: 0, False: 0}
    for _ in range(20_000):
        whole, left = rng.choice(every), rng.choice(every)
        right = rng.choice(by.get(whole[rng.randrange(len(whole))], every))
        if rng.random() < 0.5 and len(whole) > 1:  # the two halves of a piece mostly do not stay
            cut = rng.randrange(1, len(whole))
            left, right = whole[:cut], whole[cut:]
            if left not in encoder.rank or right not in encoder.rank:
                continue
        if pieces.SPACE in right.lstrip(pieces.SPACE):
            continue
        want = encoder.merged(left + right) == [left, right]
        assert encoder.compatible(left, right) == want
        n[want] += 1
    assert min(n.values()) > 2000
