"""Members of archives are read apart; what is damaged is told and stops nothing."""

import io
import random
import zipfile

from scorewright.sources import readers


def packed(members: dict[str, str], method=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("folder/", "")
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def spoiled(content: bytes, member: str, at: int = 5) -> bytes:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        i = z.getinfo(member)
    place = i.header_offset + 30 + len(member) + at
    return content[:place] + bytes([content[place] ^ 0x55]) + content[place + 1 :]


def table(n: int, seed: int = 1) -> str:
    rng = random.Random(seed)
    return "k,v,unused\n" + "".join(f'{i},"a ""b"", {rng.random()}",x\n' for i in range(n))


def test_damage_is_told_and_stops_nothing(spark, tmp_path):
    good = {"a.csv": table(30), "sub/b.CSV": "﻿v,k\n1,\n", "note.txt": "no rows", "empty.csv": ""}
    for name, content in (
        ("good", packed(good)),
        ("stored", packed(good, zipfile.ZIP_STORED)),
        ("bzip", packed({"c.csv": "k\n1\n"}, zipfile.ZIP_BZIP2)),
        ("hurt", spoiled(packed({"x.csv": table(40), "y.csv": table(3)}), "x.csv")),
        ("sum", spoiled(packed({"x.csv": table(2), "y.csv": table(3)}, zipfile.ZIP_STORED), "x.csv", 12)),
        ("head", spoiled(packed({"x.csv": table(2), "y.csv": table(3)}), "x.csv", -35)),
        ("none", b"no archive"),
        ("cut", packed(good)[:-30]),
    ):
        (tmp_path / f"{name}.zip").write_bytes(content)
    rows = readers.archive_rows(spark, str(tmp_path), ["k", "v", "gone"]).collect()
    told: dict = {}
    for r in rows:
        told.setdefault(r["archive"].rsplit("/", 1)[-1][:-4], {}).setdefault(r["member"], []).append((r["row_ord"], r["k"], r["v"], r["gone"], (r["error"] or "").split(":")[0]))
    ok = lambda n: [(i, str(i), told["good"]["a.csv"][i][2] if n == 30 else None, "", "") for i in range(n)]
    assert sorted(told["good"]["a.csv"])[:2] == sorted(ok(30))[:2] and len(told["good"]["a.csv"]) == 30
    assert told["good"]["a.csv"][0][2].startswith('a "b", 0.')
    assert told["good"]["sub/b.CSV"] == [(0, "", "1", "", "")] and set(told["good"]) == {"a.csv", "sub/b.CSV"}
    assert told["stored"] == told["good"]
    assert told["bzip"] == {"c.csv": [(-1, None, None, None, "damaged_member")]}
    for name in ("hurt", "sum", "head"):
        assert [x[0] for x in told[name]["x.csv"]] == [-1] and told[name]["x.csv"][0][4] == "damaged_member", name
        assert len(told[name]["y.csv"]) == 3, name
    for name in ("none", "cut"):
        assert told[name] == {None: [(-1, None, None, None, "damaged_archive")]}


def test_archives_as_rows(spark):
    files = spark.createDataFrame([("a", b""), ("b", None), ("c", packed({"x.csv": table(1)}))], "path string, content binary")
    got = {(r["archive"], r["member"]): (r["row_ord"], r["error"]) for r in readers.member_rows(readers.archive_members(files), ["k"]).collect()}
    assert got["c", "x.csv"] == (0, None) and got["a", None][0] == -1 and len(got) == 2


def test_limits_for_inspection(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(packed({f"{c}.csv": table(9) for c in "cab"}))
    got = readers.archive_rows(spark, str(tmp_path), ["k"], most_members=2, most_rows=4).collect()
    assert sorted((r["member"], r["row_ord"]) for r in got) == [(m, i) for m in ("a.csv", "b.csv") for i in range(4)]


def test_a_member_is_inflated_piece_by_piece():
    text = b"x" * (5 * readers.PIECE + 17)
    content = packed({"big.csv": text.decode()})
    ((_, _, method, crc, size, raw, error),) = readers._listed("p", content)
    assert error is None and readers._damage(raw, method, crc, size) is None
    pieces = list(readers._inflated(raw, method))
    assert b"".join(pieces) == text and max(map(len, pieces)) <= readers.PIECE
    assert readers._damage(raw[:-9], method, crc, size).startswith("damaged_member")
