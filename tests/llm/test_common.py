"""Word hashing on buffers against Python, and the shared folder."""

import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry import storage
from basketry.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(texts):
    raw, offsets = common.text_bytes(pa.array(texts))
    return common.Words(raw, offsets)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é日\n\t\x0b\x1f", max_size=30), max_size=8))
def test_words_and_shingles(texts):
    texts = texts or [""]
    found = words(texts)
    told = [WORD.findall(t) for t in texts]
    assert found.count.tolist() == [len(w) for w in told]
    by_hash = {}
    for h, w in zip(found.hash.tolist(), (w for own in told for w in own)):
        assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len({w for own in told for w in own})
    grams, bounds = common.shingles(found, 3)
    wanted = [[tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else [] for w in told]
    assert np.diff(bounds).tolist() == [len(g) for g in wanted]
    seen = {}
    for h, g in zip(grams.tolist(), (g for own in wanted for g in own)):
        assert seen.setdefault(h, g) == g
    assert len(seen) == len({g for own in wanted for g in own})


def test_hashes_do_not_depend_on_the_place(monkeypatch):
    draw = random.Random(1)
    told = ["".join(draw.choices("abcé", k=draw.randint(1, 12))) for _ in range(3000)] + ["x" * 5000, "y", "x" * 5000]
    text = " ".join(told)
    for stretch in (64, 1 << 18):
        monkeypatch.setattr(common, "_STRETCH", stretch)
        h = words([text]).hash
        if stretch == 64:
            first = h
    assert (first == h).all() and len(set(h.tolist())) == len(set(told)) and h[-1] == h[-3]


def test_slices_take_nulls_and_long_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 10, None, "b" * 50, "", "c"]), "k": pa.array(range(5))})
    parts = list(common.slices(batch, "text", 20))
    assert [p.column("k").to_pylist() for p in parts] == [[0, 1], [2], [3, 4]]
    assert list(common.slices(batch.slice(0, 0), "text")) == []


def test_no_temporary_folder_on_a_cluster():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="yarn", applicationId="x"))
    with pytest.raises(ValueError):
        storage.shared_dir(session)
    session.sparkContext.master = "local[2]"
    assert storage.shared_dir(session) == storage.shared_dir(session)
    session.conf.get = lambda k, d: "file:///shared/"
    assert storage.shared_dir(session) == "file:///shared"
