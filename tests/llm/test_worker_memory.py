"""What worker processes keep between tasks: the tables of one operator at a time."""

import weakref

import numpy as np
import pytest

from graphloom.llm import bpe, common, toxicity


def _reader():
    return toxicity._reader("test", lambda: toxicity.Reader(toxicity.CharModel(np.zeros(toxicity.A**4, np.int64)), {"=bad": 1.0}))


def test_operators_drop_each_others_tables():
    spec = bpe.read_spec()
    encoder = weakref.ref(bpe.load(spec))
    assert encoder() is bpe.load(spec)  # stays for the operator's next task
    reader = weakref.ref(_reader())
    assert encoder() is None and reader() is _reader()
    bpe.load(spec)
    assert reader() is None
    common.release()


def test_tasks_without_tables_drop_all():
    encoder = weakref.ref(bpe.load(bpe.read_spec()))
    assert list(common.alone(lambda batches: ((encoder(), b) for b in batches))(iter([1, 2]))) == [(None, 1), (None, 2)]


@pytest.mark.skipif(not common.resident(), reason="the system doesn't tell a process its memory")
def test_release_returns_memory():
    before = common.resident()
    blocks = [bytes(1000) for _ in range(100_000)]  # larger than what Python pools itself
    grown = common.resident() - before
    last = blocks[::1000]  # in use between and behind the free ones
    del blocks
    assert common.resident() - before > grown / 2
    common.release()
    assert common.resident() - before < grown / 2 and len(last) == 100
