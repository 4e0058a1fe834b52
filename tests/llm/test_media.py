"""The digest of a row is that of its stored tensors."""

import hashlib

import numpy as np
import pyarrow as pa

from factloom.llm import media


def test_digest_of_the_stored_tensors(monkeypatch):
    samples = bytes(range(256)) * 300
    stored, spans, _, summary = media.features(samples)
    table = pa.ipc.open_stream(stored).read_all()
    cubes = np.concatenate([c.to_numpy_ndarray() for c in table.column("tensor").chunks])
    assert cubes.shape[1:] == (media.TENSOR, media.MELS) and list(zip(table["start_s"].to_pylist(), table["end_s"].to_pylist(), strict=True)) == spans
    digest = lambda x: "sha1=" + hashlib.sha1(x.astype("<f2").tobytes()).hexdigest()[:16]
    assert summary.endswith(digest(cubes))
    store = media.arrow_tensors
    monkeypatch.setattr(media, "arrow_tensors", lambda x, spans: store(x + 1, spans))
    assert media.features(samples)[3].endswith(digest(cubes + 1))
