"""Digests of files that are read in ranges equal those of the whole files."""

import hashlib

import pytest

from marketloom.sources import digests


@pytest.mark.parametrize("most", [17, 1000, 1 << 20])
def test_digests_by_ranges(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(digests, "READ", 7)
    contents = {
        "one.bin": b"\xef", "a b%20.bin": bytes(range(40)), "é.bin": b"\n" * 30,
        "block.bin": b"x" * (64 if most == 17 else 6400),
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    asked, in_rounds = [], digests._in_rounds

    def noted(session, files, size):
        asked.extend(files)
        return in_rounds(session, files, size)

    monkeypatch.setattr(digests, "_in_rounds", noted)
    rows = digests.file_digests(spark, f"{tmp_path}/*.bin", most).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.length, r.sha256) for r in rows) == sorted(
        (name, len(c), hashlib.sha256(c).hexdigest()) for name, c in contents.items()
    )
    assert len(asked) == sum(len(c) > most for c in contents.values())
    if asked:  # a round reads no more than it may
        assert digests._advanced(asked[0], most)[3] == most


def test_state_goes_on_where_it_stopped():
    data, digest = bytes(range(256)) * 5, digests.Sha256()
    for low in range(0, len(data), 37):
        digest = digests.Sha256(digest.state())
        digest.update(data[low : low + 37])
    assert digest.hexdigest() == hashlib.sha256(data).hexdigest()
