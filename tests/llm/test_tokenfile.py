import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from caseloom.llm import tokenfile
from caseloom.session import new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = [
    "", None, " ", "  a  b ", "x\ty\nz", "日本語 𝄞𝄞", "a　 b", "a   b", "a\u0000b", "<|endoftext|> hi", "é  ü\n\n é",
    "it's 'll 12 3,4 \r\n x", "a\x85  b", "ö\x1f y", "don't stop,'now' \"ok\"", "×÷× ÿ!", "a1b2 c3", "''s", "x's", "x 's",
]


def encoded(texts):
    ids, bounds = tokenfile.tokeniser(PATH)(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_units_give_the_ids_of_the_whole_text(plain):
    assert encoded(ODD) == [plain(t) for t in ODD]


@given(text=st.text(st.sampled_from("ab Zé×ß'\n\t .,1 　日\x1c"), max_size=30))
def test_any_mixture_of_signs(plain, text):
    assert encoded([text, text]) == [plain(text)] * 2


UNCHANGED = Tokenizer.from_file(PATH)
MARKER = "<|endoftext|>"
MARKED = [
    f"abc {MARKER} def", MARKER, f"{MARKER}{MARKER}", f"a{MARKER}b", f" {MARKER} ", f"x\n {MARKER}\n\ny", f"<|endof{MARKER}text|>",
    "abc<|endof", "text|> d", f"é{MARKER}'s 日{MARKER}", f"<{MARKER}>", *ODD,
]


def test_special_tokens_are_those_of_the_unchanged_library(spark, make):
    wanted = [UNCHANGED.encode(t or "", add_special_tokens=False).ids for t in MARKED]
    ids, bounds = tokenfile.tokeniser(PATH, literal=False)(pa.array(MARKED, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == wanted
    folder = new_folder(spark, "tokens")
    files = tokenfile.write_tokens(make(list(enumerate(MARKED))), PATH, 2, folder)
    found = tokenfile.read_tokens(files, folder, arrays=True).collect()
    assert {r.doc_id: r.ids for r in found} == {i: [*w, 2] for i, w in enumerate(wanted)}


@given(text=st.lists(st.sampled_from([MARKER, MARKER[:5], MARKER[5:], "ab", " ", "\n", "'s", "é", "!", "1"]), max_size=12).map("".join))
def test_special_tokens_among_any_signs(text):
    wanted = UNCHANGED.encode(text, add_special_tokens=False).ids
    ids, bounds = tokenfile.tokeniser(PATH, literal=False)(pa.array([text, text], pa.string()))
    assert ids.tolist() == wanted * 2


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.data())
def test_random_access(ids, data):
    ids = np.array(ids, np.uint32)
    file = tokenfile.TokenFile(pa.BufferReader(tokenfile.pack(ids, [3, None], np.array([0, len(ids) // 2, len(ids)]))))
    assert file.range(0, len(ids)).tolist() == ids.tolist()
    assert file.index()[0] == [3, None] and file.index()[1].tolist() == [0, len(ids) // 2, len(ids)]
    if len(ids):
        a = data.draw(st.integers(0, len(ids) - 1))
        b = data.draw(st.integers(a, len(ids)))
        assert file.token(a) == ids[a] and file.range(a, b).tolist() == ids[a:b].tolist()


def test_files_in_ascending_order(spark, make, edge_rows, plain):
    folder = new_folder(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = tokenfile.write_tokens(make(edge_rows, extra=True).repartition(3), PATH, 2, folder, file_tokens=200)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 2
    found = sorted(tokenfile.read_tokens(files, folder, arrays=True).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    wanted = sorted((str(d), [*plain(t), 2]) for d, t in edge_rows)
    assert sorted((str(r.doc_id), r.ids) for r in found) == wanted
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found)


def test_empty_table(make):
    assert tokenfile.encode_to_files(make([]), PATH, 2).count() == 0
