import hashlib
import random
import struct
import zlib

import pytest

from fluxframe.llm import licenses, media, queries, spm


def test_round_trip_sizes():
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 65, 4096, 4097, 100_000):
        raw = bytes(rng.randrange(256) for _ in range(n))
        payload = media.pad(raw)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(raw)
        box = media.pack(payload)
        (t,) = media.probe(box)
        assert media.read(box, t) == payload and t.codec == "raw " and t.duration == len(payload) and t.timescale == media.RATE
        assert all(box[a : a + s] == payload[64 * int(k) : 64 * int(k) + s] for k, (a, s) in zip(t.keys, t.key_ranges()))


def test_damaged_files():
    box = media.pack(media.pad(b"hello"))
    for cut in (3, 20, len(box) - 1):
        with pytest.raises((ValueError, struct.error)):
            media.probe(box[:cut])
    with pytest.raises(ValueError):
        media.pack(b"x")
    assert media.probe(b"") == []


def test_sizes_of_single_samples_and_large_boxes():
    """Sample sizes in a table, no sync table, a 64-bit box size and 64-bit chunk offsets."""
    samples = [b"aaa", b"b", b"cc"]
    data = b"".join(samples)
    full = lambda k, *p: media._full(k, *p)

    def moov(at):
        stbl = media._box(b"stbl", full(b"stsd", struct.pack(">I", 1), media._box(b"mp4a", bytes(28))), full(b"stts", struct.pack(">IIIII", 2, 2, 10, 1, 5)), full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), full(b"stsz", struct.pack(">IIIII", 0, 3, 3, 1, 2)), full(b"co64", struct.pack(">IQQ", 2, at, at + 4)))
        mdhd = full(b"mdhd", bytes(8), struct.pack(">II", 1000, 25), bytes(4))
        return media._box(b"moov", media._box(b"trak", media._box(b"mdia", mdhd, media._box(b"minf", stbl))))

    at = len(moov(0)) + 16
    box = moov(at) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data
    (t,) = media.probe(box)
    assert t.codec == "mp4a" and t.duration == 25 and t.sizes.tolist() == [3, 1, 2] and media.read(box, t) == data and t.keys.tolist() == [0, 1, 2]


def test_media_query(spark, sf, docs, none):
    for r in media.digest(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        raw = (r.text or "").encode("utf-8")
        pay = media.pad(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    assert media.digest(none).count() == 0 and media.digest(docs).count() == docs.count()
    assert queries.op5_media_columns(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_media_columns(spark):
    good = media.pack(media.pad(b"payload" * 1000))
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"\0\0\0\x05junk"))], "id int, blob binary")
    got = {r.id: r for r in media.media_columns(df, "blob", "id").collect()}
    assert set(got) == {1, 3} and got[1].codec == "raw " and got[1].seconds == pytest.approx(7040 / 8000) and got[1].keyframes[0].size == 64 and got[3].error


@pytest.fixture(scope="module")
def machine():
    with open(spm.MODEL, "rb") as f:
        return spm.Transducer(f.read())


def test_encoding_equals_the_library(machine, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    rng = random.Random(3)
    cases = [r.text for r in texts.select("text").collect()]
    cases += ["", " ", "  a  b", "aaaaaaaaaaaaa", "日本語 🤖\0\t", "a▁b", "<s></s><0x41>", "x" * 300]
    cases += ["".join(rng.choice(machine.pieces[259:]) for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    for t in cases:
        assert machine.encode(t) == lib.encode(t), t[:80]
        assert machine.decode(machine.encode(t)) == lib.decode(lib.encode(t))


def test_part_memory_is_bounded(machine, monkeypatch):
    monkeypatch.setattr(spm, "REMEMBERED", 10)
    for i in range(100):
        machine.encode(f"word{i} other{i}")
    assert len(machine.older) < 500_000


def test_unigram_shortest_path():
    piece = lambda p, s, k=1: b"\x0a" + bytes([len(b := b"\x0a" + bytes([len(p)]) + p + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k]))]) + b
    model = piece(b"<unk>", 0, 2) + piece(b"a", -1.0) + piece(b"b", -1.0) + piece(b"ab", -1.5) + piece(b"abb", -4.0) + b"\x1a\x04\x18\x00\x28\x00"
    t = spm.Transducer(model)
    assert [t.pieces[i] for i in t.encode("abb")] == ["ab", "b"] and t.encode("azzb") == [1, 0, 2]


def test_shortest_path_is_the_least_of_all_paths(machine):
    def every(text, at=0, before=spm.NONE):
        if at == len(text):
            yield 0.0, []
            return
        for t in machine.arcs(text, at):
            w = machine.weight(before, t, text, at)
            for far, rest in every(text, at + machine.sizes[t], t):
                yield w + far, [t, *rest]

    for text in ["▁hello", "▁anthon", "aaaaaa", "▁é日ab", "▁▁▁x", "日"]:
        finite = [p for p in every(text) if p[0] < spm.INFINITE]
        assert len(finite) == 1 and machine.path(text) == finite[0][1]


@pytest.mark.parametrize(("squeeze", "prefix", "want"), [(True, True, "▁a▁b"), (True, False, "a▁b"), (False, True, "▁▁a▁▁b▁"), (False, False, "▁a▁▁b▁")])
def test_normaliser_machine(squeeze, prefix, want):
    model = b"\x0a\x03\x0a\x01a" + b"\x1a\x06\x18" + bytes([prefix]) + b"\x20" + bytes([squeeze]) + b"\x28\x01"
    t = spm.Transducer(model)
    assert t.symbols(" a  b ") == want and t.symbols("") == ""
    parts = t.cut.findall(" a  b ")
    assert "".join([t.symbols(parts[0]), *[t.symbols(p, spm.WORD) for p in parts[1:]]]) == want


def test_a_long_text_without_spaces(machine):
    text = "xyzerthan" * 20_000
    assert machine.decode(machine.encode(text)) == text


def test_spm_edges(docs, none):
    rows = {r.doc_id: r for r in spm.encode(docs, ["doc_id", "key"]).collect()}
    assert rows[2].n_tokens == rows[3].n_tokens == 0 and rows[2].token_ids == [] and rows[4].round_trip and not rows[11].round_trip
    assert spm.encode(none, ["doc_id"]).count() == 0
    back = {r.doc_id: r.text for r in spm.decode(spm.encode(docs, ["doc_id"]), ["doc_id"]).collect()}
    assert back[1] == "The quick erthan idiot you are." and back[2] == ""


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:])) and len(got) <= lcs(a, b)
    words = "permission is hereby granted free of charge".split()
    assert len(licenses.align(words, words)) == 7
    assert len(licenses.align(["x", *words[:3], "y", *words[3:]], words)) == 7


def test_license_scan(spark, docs, none):
    s = licenses.Scanner()
    for name, text in licenses.TEMPLATES.items():
        found = s.scan("Erthan onsh. " * 40 + text + " anthon ea" * 30)
        assert [f[0] for f in found] == [name], (name, found)
    two = s.scan("All rights reserved. x y z\nAll rights reserved.")
    assert [f[0] for f in two] == ["rights-reserved"] * 2 and two[0][1:3] == (0, 19)
    mit = licenses.TEMPLATES["MIT-permission"].replace("free of charge", "for nothing").replace("sublicense", "lend")
    assert s.scan(mit)[0][0] == "MIT-permission" and s.scan(mit)[0][3] < 1
    assert s.scan(None) == s.scan("") == s.scan("The licensed anthon of 2.0") == []
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(none).count() == 0


def test_planted_license_lines_are_found(spark):
    d = "/root/testdata/sf0.01"
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "rights-reserved"}
    got = {r.doc_id: r.licenses for r in queries.op7_license_scan(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        want = sorted(n for line, n in lines.items() for _ in range(r.text.count(line)))
        assert sorted(x.split(":")[0] for x in got[r.doc_id].split(",") if x) == want


def test_every_text_with_the_coverage_holds_a_signal():
    s, every = licenses.Scanner(), licenses.Scanner()
    every.signals = {}
    for name, t in every.templates.items():
        for w in set(t):
            every.signals.setdefault(w, []).append(name)
    every.any = licenses.WORD
    bsd = licenses.TEMPLATES["BSD-conditions"].replace("Redistribution", "Sharing").replace("modification", "changes").replace("permitted", "allowed")
    assert [f[0] for f in s.scan(bsd)] == ["BSD-conditions"]
    rng, found = random.Random(5), 0
    for name, t in s.templates.items():
        places = [k for k, w in enumerate(t)]
        rare = sorted(places, key=lambda k: (sum(t[k] in u for u in s.templates.values()), -len(t[k]), t[k]))
        for k in range(25):
            gone = set((rng.sample(places, len(t)) if k else rare)[: int(0.2 * len(t))])
            text = "erthan onsh " * 9 + " ".join(f"q{k}" if k in gone else w for k, w in enumerate(t)) + " anthon ea" * 9
            assert s.scan(text) == every.scan(text), text
            found += name in [f[0] for f in s.scan(text)]
    assert found > 300


def test_closely_repeated_notices_are_each_found():
    s = licenses.Scanner()
    for name, text in licenses.TEMPLATES.items():
        for gap in (" foo ", "\n", " foo bar baz "):
            for times in (2, 3, 5):
                found = s.scan("x " + gap.join([text] * times) + " y")
                assert [f[0] for f in found] == [name] * times and all(f[3] == 1 for f in found), (name, gap, times, found)
    altered = "x Licensed under that Apache License, Version 2.0. foo Licensed under the Apache License, Version 2.0. y"
    assert [(f[0], f[3]) for f in s.scan(altered)] == [("Apache-2.0", 6 / 7), ("Apache-2.0", 1)]


def test_ids_of_any_type_and_all_keyframes(spark):
    df = spark.createDataFrame([("a", "x" * 5000), ("b", None)], "doc_id string, text string")
    got = {r.doc_id: r for r in media.digest(df).collect()}
    assert len(got["a"].keyframes) == 5 and len(got["b"].keyframes) == 1
    assert f"first={got['a'].keyframes[0].offset}+" in got["a"].feature and f"last={got['a'].keyframes[-1].offset}+" in got["a"].feature
    from fluxframe.llm import pii

    assert {r.doc_id for r in pii.digest(df, pii.train(df)).collect()} == {"a", "b"}
