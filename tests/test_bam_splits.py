"""BAM files cut at any place against one pass over the whole file."""

import gzip
import random
import struct
import zlib

import pytest

from genospark.sources import bam_splits, readers
from genospark.sources.writers import bam_header

NAMES = [("chr1", 1_000_000), ("2", 5_000_000)]
MAGIC = bam_splits.MAGIC


def record(rng, n, long=0):
    name = f"r{n}".encode() + b"\0"
    size = long or rng.choice([0, 1, 20, 150])
    body = struct.pack("<iiBBHHHiiii", rng.choice([-1, 0, 1]), rng.randrange(-1, 9999), len(name), 60, 0, 1 if size else 0, 99, size, 0, 5, -7)
    body += name + (struct.pack("<I", size << 4) if size else b"") + rng.randbytes((size + 1) // 2) + bytes(rng.randrange(40) for _ in range(size))
    # an array that holds what a block begins with
    body += b"XMBC" + struct.pack("<i", 12) + rng.choice([MAGIC + b"\0\0\0\0\0\xff\6\0", rng.randbytes(12)])
    return struct.pack("<i", len(body)) + body


def block(data, level):
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    raw = packer.compress(data) + packer.flush()
    return MAGIC + b"\0\0\0\0\0\xff\6\0BC\2\0" + struct.pack("<H", len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(data), len(data))


def bam(rng, records, most, long=0, comment=0):
    data = bam_header("@HD\tVN:1.6\n" + "@CO\tnote\n" * comment, NAMES)
    data += b"".join(record(rng, n, long if n == records // 2 else 0) for n in range(records))
    out, at = b"", 0
    while at < len(data):
        size = rng.randrange(1, most)
        out += block(data[at : at + size], rng.choice([0, 6]))
        at += size
    return out + block(b"", 6)


@pytest.mark.parametrize("split,most,long,comment", [(900, 300, 0, 0), (2000, 5000, 30_000, 0), (700, 400, 0, 2000), (50_000, 60_000, 0, 0), (30, 200, 0, 0)])
def test_splits(spark, tmp_path, split, most, long, comment):
    rng = random.Random(split)
    files = [bam(rng, k, most, long, comment) for k in (300 if split > 9000 else 60 if split > 100 else 8, 0, 1)]
    for k, data in enumerate(files):
        (tmp_path / f"{k}.bam").write_bytes(data)
    settings = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        made = sorted(map(str, readers.read_bam(spark, str(tmp_path)).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert made == sorted(map(str, readers.read_bam(spark, str(tmp_path), whole_files=True).collect()))
    assert len(made) == sum(len(list(readers.bam_rows(gzip.decompress(f)))) for f in files)


def test_broken_files(spark, tmp_path):
    data = bam(random.Random(1), 50, 500)
    for name, wrong in (("short", data[: len(data) // 2]), ("other", b"no BAM" + data), ("gzip", gzip.compress(gzip.decompress(data)))):
        (tmp_path / name).write_bytes(wrong)
        with pytest.raises(Exception):
            readers.read_bam(spark, str(tmp_path / name)).count()


def test_first_record():
    rng = random.Random(3)
    parts = [record(rng, n) for n in range(30)]
    data = b"".join(parts)
    for cut in range(1, len(parts[0])):
        assert bam_splits.first_record(data[cut:]) == len(parts[0]) - cut
    assert bam_splits.first_record(data) == 0 and bam_splits.first_record(b"") is None
