import json

import numpy as np
import pytest

from linewright.sources import objects
from linewright.sources.tables import read_object_map


def odd_record(rng):
    word = lambda: "".join(rng.choice(list('ab"\\{}[]:, é\n🙂'), rng.integers(0, 9)))
    return {"text": word(), word(): [word(), {"deep": {"er": [1, word(), {}]}}, None, 1.5, []], "n": int(rng.integers(0, 99))}


@pytest.mark.parametrize("range_bytes", [7, 64, 1000, 1 << 20])
def test_ranges_equal_the_whole(spark, tmp_path, range_bytes, monkeypatch):
    monkeypatch.setattr(objects, "MORE_BYTES", 5)
    rng = np.random.default_rng(range_bytes)
    want = []
    for k, style in enumerate(({"separators": (",", ":")}, {"indent": 2, "ensure_ascii": False}, {})):
        held = {f"k{i}\\\"{{" + "\\" * int(rng.integers(0, 5)): odd_record(rng) for i in range(3 if range_bytes == 7 else 40)}
        (tmp_path / f"{k}.json").write_text(("﻿" if k == 1 else "") + json.dumps(held, **style) + "\n", encoding="utf-8")
        want += [(f"{k}.json", i, key, value) for i, (key, value) in enumerate(held.items())]
    (tmp_path / "none.json").write_text("")
    (tmp_path / "empty.json").write_text(" { } ")
    rows = objects.read_members(spark, str(tmp_path), range_bytes).collect()
    assert sorted((r.path.rsplit("/")[-1], r.ordinal, r.key, repr(json.loads(r.value))) for r in rows) == sorted((f, i, k, repr(v)) for f, i, k, v in want)


def test_many_tasks_and_key_filter(spark, tmp_path):
    held = {f"{'EN' if i % 3 else 'JP'}/{i:06d}.wem": {"text": f"line {i}, \"so\" {{it}} says", "voice": [i]} for i in range(20_000)}
    (tmp_path / "m.json").write_text(json.dumps(held))
    members = objects.read_members(spark, str(tmp_path / "m.json"), 100_000)
    assert members.rdd.getNumPartitions() > 10 and members.count() == 20_000
    rows = read_object_map(spark, str(tmp_path / "m.json"), "text string, voice array<int>", prefix="JP/").collect()
    assert len(rows) == 6_667 and all(r.ordinal % 3 == 0 and r.voice == [r.ordinal] and held[r.key]["text"] == r.text for r in rows)


def test_broken_files_are_errors(spark, tmp_path):
    for k, text in enumerate(('{"a": 1', "[1, 2]", '{"a"}')):
        (tmp_path / f"{k}.json").write_text(text)
        with pytest.raises(Exception, match="cut short|no JSON object|without a value"):
            objects.read_members(spark, str(tmp_path / f"{k}.json")).collect()
