"""Token files, WARC archives and URL filters: exact round trips and brute force."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riverloom.llm import common, hosts, token_files, warc
from riverloom.llm.queries import tokenizer_path

TEXTS = ["", "a b c", "  two\n\n lines 's don't", None, "日本 text", "<|endoftext|> x", "x" * 5000, "é à la\tmode 12 + 3", "x\x1cy\x85z", "a b  \n", "!!'s ''t 'll'"]


TEXTS += ["a <|endoftext|>", "x <|endoftext|> y", "<|startoftext|><|endoftext|>", "<| endoftext |>", "Über\u2028ß", "I'LL we'll", "e\u0301 É", "\u00a0 a\u00a0", "12345678901", "🙂 ok"]


@pytest.fixture(scope="module")
def library():
    """The library as it is, without a setting of ours."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("special_as_text", [False, True])
def test_ids_are_the_librarys(monkeypatch, name, special_as_text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path(name))
    if special_as_text:
        plain.encode_special_tokens = True
    enc = token_files.Encoder(tokenizer_path(name), special_as_text)
    texts = [t or "" for t in TEXTS]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.encode(texts)] == want
    assert [x.tolist() for x in enc.encode(texts)] == want
    monkeypatch.setattr(token_files, "CACHE_PIECES", 3)
    assert [x.tolist() for x in enc.encode(texts)] == want
    assert enc.cuts == (name == "byte_bpe_50k.json")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'<|>sltrevmd09aZéßſ¡"), st.characters(codec="utf-8")), max_size=60), max_size=4))
def test_ids_of_any_text_are_the_librarys(texts):
    enc = token_files._encoder(tokenizer_path(), special_as_text=False)
    assert [x.tolist() for x in enc.encode(texts)] == [enc.lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_only_known_tokenizers_are_cut(library):
    spec = json.loads(library.to_str())
    assert token_files.cuts_as_known(spec)
    assert not token_files.cuts_as_known(spec | {"normalizer": {"type": "NFC"}})
    assert not token_files.cuts_as_known(spec | {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}})
    assert not token_files.cuts_as_known(spec | {"pre_tokenizer": {"type": "Whitespace"}})
    assert not token_files.cuts_as_known(spec | {"model": spec["model"] | {"end_of_word_suffix": "</w>"}})


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_files_give_back_every_document(spark, name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(name))
    rows = [(k * 3 % 17, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (5, "again"), (5, "again"), (40, "very long " * 200_000)]
    rows += [(None, f"hot {k}") for k in range(40)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, shard int, path string")
    folder = common.new_folder(spark, "t")
    manifest = token_files.write_token_files(df, folder, tokenizer_path(name), end_id=2, shards=6)
    got = token_files.read_token_files(spark, folder, manifest).collect()
    assert sum(r.n_docs < 40 for r in manifest.collect()) >= 3  # rows without ids are in several files
    hashed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    ordered = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h, r.text))
    start, want = 0, []
    for i, t, _ in ordered:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted([tuple(r) for r in got], key=lambda r: r[1]) == want
    assert sum(r.n_ids for r in manifest.collect()) == start


def test_no_documents_give_no_files(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder = common.new_folder(spark, "t")
    manifest = token_files.write_token_files(df, folder, tokenizer_path())
    assert manifest.count() == 0 and token_files.read_token_files(spark, folder, manifest).count() == 0


def test_any_decoder_reads_a_file_and_damage_is_found(tmp_path):
    import zstandard

    out = common.SharedWriter(str(tmp_path), "x.zst")
    w = token_files.FrameWriter(out, 2)
    docs = [np.array([1, 2, 3]), np.array([50256]), np.arange(1000) % 7]
    for k, d in enumerate(docs):
        w.add(k, d)
    w.finish()
    path = out.commit()
    raw = open(path, "rb").read()
    assert struct.unpack("<I", raw[-4:])[0] == token_files.SEEKABLE
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert np.frombuffer(stream, "<u2").tolist() == [x for d in docs for x in d.tolist()]
    fs, at = common.filesystem(path)
    reader = token_files.FrameReader(fs, at)
    assert len(reader) == 3 and reader.ids(2).tolist() == docs[2].tolist() and reader.doc_ids.tolist() == [0, 1, 2]
    table = bytearray(raw)
    table[-9 - 36 + 8] ^= 1  # the first frame's checksum
    open(path, "wb").write(bytes(table))
    with pytest.raises(ValueError, match="checksum"):
        token_files.FrameReader(fs, at).ids(0)


def pages():
    same = "<html>same</html>"
    return [(3, "https://a/1", same), (1, "https://a/2", same), (2, None, "x\r\n\r\nWARC/1.1 é"), (4, "u\nv", None), (5, "u", ""), (6, "u", "z" * 3_000_000), (3, "https://a/1", same), (None, "n", same), (None, "n", "alone")]


def test_archives_give_back_every_record(spark):
    names = "page_id long, url string, html string, first int, payload string, id long, __digest string, path string"
    df = spark.createDataFrame([(*r, 1, "p", 9, "d", "x") for r in pages()], names).repartition(3)
    raw, folder = common.new_folder(spark, "raw"), common.new_folder(spark, "warc")
    streams = warc.write_archives(df, raw)
    archives = warc.normalise(streams, folder)
    got = sorted((tuple(r) for r in warc.read_archives(spark, archives).collect()), key=str)
    want = []
    firsts = {}
    for i, _, h in pages():
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    for i, _, h in pages():
        body = (h or "").encode()
        many = sum((x[2] or "") == (h or "") for x in pages()) > 1
        first = firsts.get(h or "")
        revisit = many and first is not None and i != first
        want.append((i, len(body), warc.digest32(body), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert sum(r.n_records for r in streams.collect()) == len(pages())


def test_normalised_files_have_a_member_per_record(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1)
    streams = warc.write_archives(df, common.new_folder(spark, "raw"))
    source = open(streams.first().path, "rb").read()
    one = zlib.decompressobj(31)
    content = one.decompress(source)
    assert one.eof and not one.unused_data  # one member holds everything
    row = warc.normalise(streams, common.new_folder(spark, "warc")).first()
    data = open(row.path, "rb").read()
    assert gzip.decompress(data) == content
    entries = [json.loads(x) for x in open(row.index_path)]
    assert [e["offset"] for e in entries] == np.cumsum([0, *[e["length"] for e in entries[:-1]]]).tolist()
    for e in entries:
        headers, block = warc.parse(gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]))
        assert headers["warc-type"] == e["type"] and len(block) == int(headers["content-length"])
        if e["type"] == "response":
            assert "sha1:" + warc.digest32(warc.payload_of(block)[1]) == e["digest"]


def test_normaliser_reads_many_members_and_refuses_broken_streams(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    recs = [warc.record(k, f"u{k}", b"payload %d" % k, None, False, "2024-01-01T00:00:00Z") for k in range(5)]
    path = tmp_path / "m.gz"
    path.write_bytes(b"".join(map(gzip.compress, recs)))
    fs, at = common.filesystem(str(path))
    assert list(warc.records(warc.inflate(fs, at))) == recs
    path.write_bytes(gzip.compress(b"".join(recs)[:-9]))
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate(fs, at)))
    path.write_bytes(gzip.compress(b"nonsense\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate(fs, at)))


def test_no_pages_give_no_archives(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    streams = warc.write_archives(df, common.new_folder(spark, "raw"))
    archives = warc.normalise(streams, common.new_folder(spark, "warc"))
    assert warc.read_archives(spark, archives).count() == 0


# ------------------------------------------------------------- URL filters


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
    rest = rest[k:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def rule(host, path):
    fits = [r for r in hosts.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "nope", "https://X.Example.NET/en/a?b#c", "http://example.net", "http://example.net?x=/en/", "ftp://a.net/", "http://notnet/", "http://b.example.com/de/x", "http://example.com/d", "http://o.org/fr/", "http://o.org#/fr/", "x://y://z/en", "http://ÄB.net/Ö", "http://example.net/en/../", "http://a.b:80/p\nq?x", "https://u@h.org/fr/x"]
    df = spark.createDataFrame([(k, u, "", "v", "r") for k, u in enumerate(urls)], "page_id long, url string, html string, verdict string, rule string")
    got = {r.page_id: r for r in hosts.judge(df, rounds=2).collect()}
    for k, u in enumerate(urls):
        host, path = parts(u)
        r = rule(host, path)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, r and r.text), u
        if r:
            assert got[k].verdict == r.action
    assert got[0].verdict == "allow"


def rank(edges, seeds, rounds, damping=hosts.DAMPING):
    total = {}
    for a, _, w in edges:
        total[a] = total.get(a, 0) + w
    mass = sum(seeds.values())
    start = {h: w / mass for h, w in seeds.items()}
    now = dict(start)
    for _ in range(rounds):
        back = 1 - damping * sum(x for h, x in now.items() if h in total)
        new = {h: x * back for h, x in start.items()}
        for a, b, w in edges:
            new[b] = new.get(b, 0) + damping * now.get(a, 0) * w / total[a]
        now = new
    return now


def link(*to):
    return "".join(f'<a href="{t}">x</a>' for t in to)


def test_rank_of_hosts_without_links_returns_to_the_seeds(spark, monkeypatch):
    monkeypatch.setattr(hosts, "TOLERANCE", 2e-5)
    rows = [
        (1, "https://t.org/fr/", link(*["https://x.com/"] * 8, *["https://y.com/"] * 2)),
        (2, "https://x.com/", link("https://b.net/")),
        (3, "https://u.com/", link("https://t.org/fr/")),
        (4, "https://v.com/", link("https://u.com/")),
        (5, "https://b.net/", None),
        (6, "https://y.com/", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in hosts.judge(df).collect()}
    assert got[2].verdict == "allow" and abs(got[2].trust - 0.280) < 5e-4 and abs(got[2].distrust - 0.229) < 5e-4
    assert hosts.judge(df, threshold=0.4).where("page_id = 2").first().verdict == "block"
    edges = hosts.host_edges(df).withColumn("kind", F.lit("trust"))
    seeds = spark.createDataFrame([("trust", "t.org", 3.0), ("trust", "y.com", 1.0)], "kind string, host string, weight double")
    assert abs(hosts.propagate(edges, seeds, rounds=7).agg(F.sum("score")).first()[0] - 1) < 1e-12


def test_hosts_equal_their_sql_where_they_link(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hosts, "TOLERANCE", 1e-6)
    import duckdb

    from riverloom.llm import oracles, queries

    rng = random.Random(8)
    names = [f"h{k}.com" for k in range(12)] + ["a.net", "b.org", "c.example.com"]
    rows = []
    for k in range(60):
        to = [f"https://{rng.choice(names)}/p" for _ in range(rng.randint(0, 4))]
        html = rng.choice([None, link(*to) + "text " * 40_000, link(*to)])
        rows.append((k, rng.choice([None, f"https://{rng.choice(names)}/{rng.choice(['fr/', 'de/', ''])}"]), html))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = con.sql(oracles.hosts_sql())
    names = [d[0] for d in found.description]
    got = queries.queries()["op2_hosts"](spark, str(tmp_path)).select(*names).collect()
    key = lambda r: (r["page_id"], r["host"], r["path"], r["rule"], r["verdict"])
    want = {key(r): (r["trust"], r["distrust"]) for r in (dict(zip(names, x, strict=True)) for x in found.fetchall())}
    assert {key(r) for r in got} == set(want)
    assert all(abs(r.trust - want[key(r)][0]) < 2e-5 and abs(r.distrust - want[key(r)][1]) < 2e-5 for r in got)
    assert {v for *_, v in want} == {"allow", "block"} and max(d for _, d in want.values()) > 0


def test_trust_and_distrust_spread_over_links(spark):
    pages_ = [
        (1, "https://good.org/fr/1", link("https://friend.com/x", "//Friend.com/y", "/local", "https://good.org/z")),
        (2, "https://friend.com/", link("https://farm.com/1")),
        (3, "https://farm.com/2", link("https://bad.net/a", "https://bad.net/b") + "<a HREF='http://friend.com'>"),
        (4, "https://bad.net/x", link("https://farm.com/")),
        (5, "https://lonely.com/", None),
        (6, "https://farm.com/3", link("https://bad.net/c")),
    ]
    df = spark.createDataFrame(pages_, "page_id long, url string, html string")
    edges = {tuple(r[:2]): r[2] for r in hosts.host_edges(df).collect()}
    assert edges == {("good.org", "friend.com"): 2, ("friend.com", "farm.com"): 1, ("farm.com", "bad.net"): 3, ("farm.com", "friend.com"): 1, ("bad.net", "farm.com"): 1}
    rows = [(a, b, w) for (a, b), w in edges.items()]
    trust = rank(rows, {"good.org": 1}, 6)
    distrust = rank([(b, a, w) for a, b, w in rows], {"bad.net": 1}, 6)
    got = {r.page_id: r for r in hosts.judge(df, rounds=6).collect()}
    for r in got.values():
        assert abs(r.trust - trust.get(r.host, 0)) < 1e-12 and abs(r.distrust - distrust.get(r.host, 0)) < 1e-12
    for k in (2, 3, 5, 6):
        assert got[k].verdict == ("block" if distrust.get(got[k].host, 0) > trust.get(got[k].host, 0) else "allow")


def test_distrust_reaches_far_hosts(spark, monkeypatch):
    monkeypatch.setattr(hosts, "TOLERANCE", 1e-5)
    rows = [(k, f"https://h{k}.com/", link(f"https://h{k - 1}.com/" if k else "https://bad.net/")) for k in range(14)]
    rows += [(20, "https://bad.net/", None), (21, "https://good.org/fr/", link("https://mid.com/", *(f"https://leaf{k}.com/" for k in range(9))))]
    rows += [(22, "https://mid.com/", link("https://bad.net/", "https://end.com/", "https://end.com/"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in hosts.judge(df).collect()}
    assert all(got[k].distrust > 0 and got[k].verdict == "block" for k in range(14))
    edges = [tuple(r) for r in hosts.host_edges(df).collect()]
    for kind, e, seed in (("trust", edges, {"good.org": 1}), ("distrust", [(b, a, w) for a, b, w in edges], {"bad.net": 1})):
        want = rank(e, seed, 300)
        assert all(abs(r[kind] - want.get(r.host, 0)) < 1e-4 for r in got.values())


def test_no_pages(spark):
    assert hosts.judge(spark.createDataFrame([], "page_id long, url string, html string"), rounds=2).count() == 0


def test_digest_is_bare_base32():
    assert warc.digest32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").digest()
