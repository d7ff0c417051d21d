import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from caseloom.llm import pieces
from caseloom.llm.units import UnitCache

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def spans(library, text):
    proto = library.encode(text, return_type="proto")
    return [(p.id, p.begin, p.end) for p in proto.pieces]


def own(texts):
    ids, bounds, begins, ends = pieces.encoder(PATH)(pa.array(texts, pa.string()))
    return [list(zip(*(x[a:b].tolist() for x in (ids, begins, ends)))) for a, b in zip(bounds, bounds[1:])]


ODD = ["", " ", "a", "  a  b ", "x\ty\nz", "▁a ▁ b▁c", "日本語テスト 𝄞𝄞 ☃☃", "a\u0000b", "  \n \n", "😀 hi<s> </s> <0x41>", "é ü"]


def test_ids_and_spans_are_the_librarys(library):
    assert own(ODD) == [spans(library, t) for t in ODD]


@given(text=st.text(st.sampled_from("ab ▁é日𝄞\n<0>"), max_size=25))
def test_any_mixture_of_signs(library, text):
    assert own([text, "x", text])[2] == spans(library, text)


def with_rule(rule, unigram, folder):
    """The public vocabulary with the normaliser of a named rule, as it is or scored by pieces without bytes."""
    with open(PATH, "rb") as file:
        model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    rules = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    model.normalizer_spec.CopyFrom(sentencepiece_model_pb2.ModelProto.FromString(rules).normalizer_spec)
    for name in ("add_dummy_prefix", "remove_extra_whitespaces", "escape_whitespaces"):
        setattr(model.normalizer_spec, name, True)
    if unigram:
        model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, False
        rest = [p for p in model.pieces if p.type != pieces.BYTE]
        del model.pieces[:]
        model.pieces.extend(rest)
    path = f"{folder}/{rule}{unigram}.model"
    with open(path, "wb") as file:
        file.write(model.SerializeToString())
    return path


@pytest.mark.parametrize("rule", ["nmt_nfkc_cf", "nfkc"])
@pytest.mark.parametrize("unigram", [False, True])
def test_spans_through_a_character_map(rule, unigram, tmp_path):
    path = with_rule(rule, unigram, tmp_path)
    reference = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    signs = "abc Abé  日𝄞\n\tﬁ①ＡЖ́ßİ☃️👍▁.!"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    ids, bounds, begins, ends = pieces.Encoder(path)(pa.array(texts))
    found = [list(zip(*(x[a:b].tolist() for x in (ids, begins, ends)))) for a, b in zip(bounds, bounds[1:])]
    assert found == [spans(reference, t) for t in texts]


def test_only_what_is_asked_for(make):
    found = pieces.encode(make([(1, "some text"), (None, None)]), PATH, extra=["ids"])
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    whole = pieces.encode(make([(1, "some text"), (None, None)]), PATH)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.select(found.columns).collect()))


def test_the_cache_is_bounded_by_bytes():
    calls = []
    cache = UnitCache(lambda units: calls.append(len(units)) or [[len(u)] * 2 for u in units], most=20_000)
    for start in (0, 0, 200, 400, 0):
        units = pa.array([f"unit {i}".encode() for i in range(start, start + 50)] * 2, pa.large_binary())
        ids, lengths = cache(units)
        assert ids.tolist() == [len(f"unit {i}") for _ in range(2) for i in range(start, start + 50) for _ in range(2)]
        assert lengths.tolist() == [2] * 100 and cache.size <= 20_000
    assert calls == [50, 50, 50, 50]


def test_documents(library, make, edge_rows):
    found = pieces.encode(make(edge_rows, extra=True), PATH).collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    wanted = []
    for doc_id, text in edge_rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        wanted.append((str(doc_id), len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids).encode())))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(wanted)
    for r in found:
        text = dict(edge_rows)[r.doc_id] if r.doc_id not in (1, None) else None
        assert len(r.ids) == len(r.begins) == len(r.ends) == r.n_tokens
        if text is not None:
            assert r.covered_bytes == len(text.encode()) and r.decoded == library.decode(r.ids)
    assert pieces.encode(make([]), PATH).count() == 0


def double_array(entries: dict[bytes, bytes]) -> bytes:
    """A compiled map for a few one-byte and two-byte keys, built by hand: one free block per node."""
    texts, places = b"", {}
    for key, value in entries.items():
        places[key] = len(texts)
        texts += value + b"\0"
    nodes = sorted({key[:i] for key in entries for i in range(len(key) + 1)}, key=len)
    base = {node: 256 * (i + 1) for i, node in enumerate(nodes)}
    units = [0] * (256 * (len(nodes) + 2))
    where = {b"": 0}
    for node in nodes:
        if node:
            where[node] = base[node[:-1]] ^ node[-1]
        offset = where[node] ^ base[node]
        label = node[-1] if node else 0
        units[where[node]] = offset << 10 | (node in entries) << 8 | label
        if node in entries:
            units[base[node]] = 1 << 31 | places[node]
    raw = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(raw)) + raw + texts


def normaliser(squeeze):
    model = sentencepiece_model_pb2.ModelProto()
    model.normalizer_spec.precompiled_charsmap = double_array({b"A": b"a", b"AB": b"xyz", b"\t": b" ", b"\xc3\xa9": b"e"})
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.escape_whitespaces = True
    return pieces.Normaliser(model)


def test_longest_prefixes_and_alignment():
    text, source = normaliser(False)("AABé\tq".encode())
    assert text.decode() == "▁axyze▁q"
    assert source == [0, 0, 0, 0, 1, 1, 1, 3, 5, 5, 5, 6, 7]


def test_extra_blanks_are_removed():
    text, source = normaliser(True)("  A \t B  ".encode())
    assert text.decode() == "▁a▁B"
    assert source[:4] == [2, 2, 2, 2] and source[-1] == 7
    assert normaliser(True)(b"  ") == (b"", [2])
