"""Six JSONL files keep file order through FILE_ORDER positions (Spark packs
splits into partitions by size, not by name)."""

import os

from tessera.operators.order import FILE_ORDER, with_pos
from tessera.sources.readers import read_jsonl


def test_six_files_keep_name_order(spark, tmpdir_path):
    expected = []
    for f in range(6):
        n = 3 + (5 - f) * 40  # later files are smaller, so size-based packing reorders them
        with open(os.path.join(tmpdir_path, f"part-{f}.jsonl"), "w") as out:
            for i in range(n):
                out.write('{"text": "f%d-%d"}\n' % (f, i))
                expected.append(f"f{f}-{i}")
    df = read_jsonl(spark, tmpdir_path, "text string", with_file_order=True)
    got = [r.text for r in with_pos(df, list(FILE_ORDER), "pos").orderBy("pos").collect()]
    assert got == expected
