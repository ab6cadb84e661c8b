"""The training-data operators against brute force, on odd tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import base64
import collections
import gzip
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import queries, sentencepiece_fst
from larkspur.llm.chat_quotes import thread_conversations
from larkspur.llm.common import Workspace
from larkspur.llm.decontaminate import drop_leaks, find_leaks
from larkspur.llm.language_id import address_host, identify
from larkspur.llm.line_dedup import LineRuns, dedup_lines
from larkspur.llm.media_columns import SCHEME, interleave, media_features, media_store, pad, parse_sequence, read_png, write_png
from larkspur.llm.minhash_dedup import near_duplicates
from larkspur.llm.quality_pu import score_quality, train
from larkspur.llm.secret_scan import find_all, find_secrets
from larkspur.llm.sentencepiece_fst import Machine, encode_documents
from larkspur.llm.suffix_dedup import remove_repeats
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans int, score string"
WORDS = [f"w{i * 7919 % 1000}" for i in range(400)]
LONG = " ".join(f"{a}{i}" for i, a in enumerate(WORDS * 20))


def odd(spark):
    base = " ".join(WORDS[:120])
    rows = [
        (1, base), (2, base), (3, base + " tail"), (3, base + " tail"), (4, None), (5, ""), (6, "   \n\t"), (7, LONG), (8, LONG + "x"), (None, base), (None, None), (9, "a b"), (10, "a b"),
        (11, "x" * 900), (12, "Ä" * 500 + base), (13, "Shared line of twenty chars\n\nshared LINE of twenty chars \nown"), (14, " shared line of twenty chars\r\nb"), (15, "shared line of twenty chars"),
    ]
    return spark.createDataFrame([(i, x, "en", "h", None, "k", 1, "s") for i, x in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def brute_repeats(texts, length):
    seen = collections.Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((bytes(c for c, g in zip(b, gone, strict=True) if not g), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))))
    return out


@pytest.mark.parametrize("make,length,q", [(docs, 400, 96), (odd, 60, 16), (odd, 400, 96)])
def test_suffix_dedup(spark, make, length, q):
    df = make(spark)
    rows = df.collect()
    want = sorted(((r["doc_id"] or -1), hashlib.sha256(k).hexdigest(), n) for r, (k, n) in zip(rows, brute_repeats([(r["text"] or "").encode() for r in rows], length), strict=True))
    got = remove_repeats(df, length=length, q=q).collect()
    assert sorted(((r["doc_id"] or -1), r["kept_sha256"], len(r["spans"])) for r in got) == want
    assert all(r["n_bytes"] - r["n_removed"] == len(r["kept"]) for r in got)


def test_text_ids(spark):
    """Ids that are texts, null ones included, give what numbers give."""
    df = odd(spark)
    named = df.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.format_string("%04d", "doc_id")))
    for run in (lambda x: remove_repeats(x, length=60, q=16).select("doc_id", "kept_sha256"), lambda x: dedup_lines(x).select("doc_id", "kept")):
        want, got = ([tuple(r) for r in run(x).collect()] for x in (df, named))
        assert collections.Counter((int(i) if i else None, x) for i, x in got) == collections.Counter(want)
    with pytest.raises(TypeError):
        remove_repeats(df.withColumn("doc_id", F.lit(1.5)))


@pytest.mark.parametrize("length,q", [(40, 8), (90, 30)])
def test_suffix_dedup_at_random(spark, length, q):
    """Texts put together from few passages, shifted and cut, over few letters: all levels of refinement are needed."""
    rng = random.Random(length)
    passages = ["".join(rng.choices("ab ", k=rng.randrange(20, 200))) for _ in range(30)]
    texts = ["".join(rng.choice(passages)[rng.randrange(15) :] for _ in range(rng.randrange(1, 9))) for _ in range(150)] + ["a" * 500, "ab" * 200, "ab" * 130 + "a"]
    got = remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=length, q=q).collect()
    want = brute_repeats([x.encode() for x in texts], length)
    assert [(hashlib.sha256(k).hexdigest(), n) for k, n in want] == [(r["kept_sha256"], len(r["spans"])) for r in sorted(got, key=lambda r: r["doc_id"])]


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize("make", [docs, odd])
def test_line_dedup(spark, make):
    df = make(spark)
    held = collections.defaultdict(set)
    rows = [(r["doc_id"] if r["doc_id"] is not None else -(1 << 63), (r["text"] or "").split("\n")) for r in df.collect()]
    for i, lines in rows:
        for x in lines:
            held[key(x)].add(i)
    want = sorted((i, "\n".join(x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == i)) for i, lines in rows)
    got = dedup_lines(df).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["kept"]) for r in got) == want


def test_line_runs(spark):
    runs = LineRuns(spark, Workspace(spark, "test"), buckets=2)
    for batch in ([(1, 1, 10), (2, 2, 10)], [(1, 1, 20)], [(1, 1, 5), (3, 3, 5)]):
        runs.add(spark.createDataFrame(batch, "h1 long, h2 long, doc_id long"))
    assert sorted(map(tuple, runs.state().collect())) == [(1, 1, 3, 20), (2, 2, 1, 10), (3, 3, 1, 5)]
    assert [len(x) for x in runs.levels] == [1, 1]


def test_line_runs_have_few_files(spark, monkeypatch):
    """A run of few rows has no file for each shuffle partition; the rows are the same."""
    written, write = [], LineRuns._write

    def watched(self, df):
        name = write(self, df)
        written.append(len(self.spark.table(name).inputFiles()))
        return name

    df = docs(spark)
    want = sorted(map(tuple, dedup_lines(df).collect()))
    monkeypatch.setattr(LineRuns, "_write", watched)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = dedup_lines(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got)) == want
    assert len(written) == 7 and max(written) <= spark.sparkContext.defaultParallelism


def brute_near(rows, k, share):
    sets, parent = {}, {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", key("." + (text or ""))[1:] if text else "")
        sets.setdefault(i, []).append({tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(parent)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    both = len(x & y)
                    if both and share[1] * both >= share[0] * len(x | y):
                        p, q = root(a), root(b)
                        parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("make,k", [(docs, 4), (docs, 5), (odd, 4)])
def test_near_duplicates(spark, make, k):
    df = make(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute_near([r for r in rows if r[0] is not None], k, (80, 100))
    got = near_duplicates(df, shingle=k).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("text_ids", [False, True])
def test_near_duplicate_ids(spark, text_ids):
    """Rows that share an id are one node, whatever their texts; ids may be texts."""
    a, b, c = (" ".join(WORDS[k : k + 60]) for k in (0, 100, 200))
    rows = [(1, a), (3, a), (3, b), (9, b), (9, None), (12, ""), (12, c), (14, c + " end"), (15, None), (15, "")]
    assert len(rows) == 10
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select(F.format_string("d%03d", "doc_id").alias("doc_id"), "text") if text_ids else df
    got = near_duplicates(df, shingle=4).collect()
    name = (lambda i: f"d{i:03d}") if text_ids else int
    want = {name(i): name(j) for i, j in brute_near(rows, 4, (80, 100)).items()}
    assert len(got) == 10 and {r["doc_id"]: r["component_id"] for r in got} == want and want[name(9)] == name(1) and want[name(14)] == name(12)
    assert all(r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicate_blocks(spark, monkeypatch):
    """Groups of many blocks with chains, whose ends aren't alike, and strays: against all pairs."""
    from larkspur.llm import minhash_dedup

    monkeypatch.setattr(minhash_dedup, "BLOCK", 5)
    rng = random.Random(3)
    rows = [(i, " ".join(WORDS[:100] + [f"v{i}", f"u{i}"])) for i in range(23)]
    chain = WORDS[150:250]
    for i in range(100, 160):
        chain = list(chain)
        chain[rng.randrange(10, 90)] = f"x{i}"
        rows.append((i, " ".join(chain)))
    rows += [(200 + i, " ".join(rng.choice((w, f"z{rng.random()}")) if k % 7 == i % 7 else w for k, w in enumerate(WORDS[260:330]))) for i in range(40)]
    rng.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_near(rows, 4, (80, 100))


def test_secrets(spark):
    aws, token = "AKIA" + "Q" * 16, "secret=abcdef123"
    plain = f"Token: abcdef x {aws} {'0af' * 9} password = ab"
    base, spans = find_all(plain)
    assert [k for k, *_ in base] == ["assign", "access", "hex"] and len(spans) == 3
    layers = [
        base64.b64encode(token.encode()).decode(), base64.b64encode(gzip.compress(token.encode())).decode(), base64.b64encode(base64.b64encode(token.encode())).decode(),
        base64.b64encode(zlib.compress(token.encode())).decode(),
    ]
    for layer in layers:
        _, spans = find_all(f"é {layer} end")
        assert ("assign", 2, 2 + len(layer.rstrip("="))) in [(s.kind, s.start, s.end) if s.end == 2 + len(layer.rstrip("=")) else (s.kind, s.start, s.end - layer.count("=")) for s in spans]
    _, spans = find_all("x secret%3Dabcdef123 y")
    assert [(s.kind, s.start, s.end) for s in spans] == [("assign", 2, 20)]
    _, spans = find_all("x secret\\u003dabcdef123 y")
    assert [(s.start, s.end) for s in spans] == [(2, 23)]
    rows = find_secrets(odd(spark)).collect()
    assert len(rows) == 18 and not any(r["spans"] for r in rows) and find_secrets(empty(spark)).count() == 0
    planted = spark.createDataFrame([(1, plain)], "doc_id long, text string")
    assert find_secrets(planted).first()["base"] == find_secrets(planted).first()["spans"]


def test_secrets_of_whole_streams(monkeypatch):
    """Nothing behind a length, a member or a window is lost, wherever windows end."""
    from larkspur.llm import secret_scan

    token = b"token=abcdef123"
    late = gzip.compress("é, ".encode() * (17 << 20) + token, 1)  # over 64 MiB
    for data in (gzip.compress(b"first") + gzip.compress(token), zlib.compress(b"first") + zlib.compress(token), late, gzip.compress(token)[:-8] + b"12345678"):
        layer = base64.b64encode(data).decode()
        assert [(s.kind, s.start, s.end, s.layer) for s in find_all(f"x {layer}")[1]] == [("assign", 2, 2 + len(layer), "text>base64+deflate")]
    for name, size in (("CHUNK", 500), ("WINDOW", 2000), ("LONG", 8000)):
        monkeypatch.setattr(secret_scan, name, size)
    noise = random.Random(1).randbytes(20000)
    for inner in (base64.b64encode(noise + token), base64.encodebytes(noise + token), b"x" * 30000 + b" " + token, b"a b " * 9000 + token):
        layer = base64.b64encode(gzip.compress(inner)).decode()
        assert {(s.kind, s.start, s.end) for s in find_all(layer)[1]} == {("assign", 0, len(layer))}


def test_secret_cycles(monkeypatch):
    """An archive that holds itself ends the worklist; what stands beside it is found."""
    from larkspur.llm import secret_scan

    packed = gzip.compress(b"self") + b"token=abcdef123"
    monkeypatch.setattr(secret_scan, "_inflate", lambda chunks: iter([b"".join(chunks)]))
    text = base64.b64encode(packed).decode()
    for size in (1 << 18, 8):
        monkeypatch.setattr(secret_scan, "CHUNK", size)
        monkeypatch.setattr(secret_scan, "WINDOW", 4 * size)
        monkeypatch.setattr(secret_scan, "LONG", 16 * size)
        assert {s.kind for s in find_all(f"x {text} y")[1]} == {"assign"}


def test_nested_secrets_against_brute_force():
    """Random nests of layers around a secret: found once at the place of the outermost layer."""
    from urllib.parse import quote

    rng = random.Random(6)
    wraps = {
        "base64": lambda x: base64.b64encode(x.encode()).decode().rstrip("="), "gzip": lambda x: base64.b64encode(gzip.compress(x.encode())).decode(), "zlib": lambda x: base64.urlsafe_b64encode(zlib.compress(x.encode())).decode(),
        "url": lambda x: "".join(f"%{b:02X}" for b in x.encode()), "unicode": lambda x: "".join(f"\\u{ord(c):04x}" for c in x), "quoted": lambda x: quote(x, safe=""),
    }
    for _ in range(60):
        plan = [rng.choice(sorted(wraps)) for _ in range(rng.randrange(1, 4))]
        inner = rng.choice(("token=abcdef123", "AKIA" + "Q7" * 9, "0123456789abcdef" * 2))
        layer = inner
        for name in plan:
            layer = wraps[name](layer)
        front = rng.choice(("see ", "é: ", "(", "http://a.example/b/"))
        text = f"{front}{layer} end"
        found = [s for s in find_all(text)[1] if s.layer != "text"]
        kind = {"t": "assign", "A": "access", "0": "hex"}[inner[0]]
        mine = [s for s in found if s.kind == kind]
        assert (mine or layer == inner or inner in text) and all(0 <= s.start < s.end <= len(text) for s in found), (plan, inner)
        assert any(s.start >= len(front) - 20 and s.end <= len(front) + len(layer) for s in mine) or inner in text, (plan, inner, mine)


def test_secrets_of_wrapped_and_odd_layers():
    from urllib.parse import quote, quote_plus

    token, noise = b"token=abcdef123", random.Random(2).randbytes(300)
    wrapped = [base64.encodebytes(x).decode() for x in (gzip.compress(noise + token), zlib.compress(noise + token), b"lorem ipsum dolor sit amet consectetur adipiscing, " + token + b" etc")]
    pem = "-----BEGIN CERTIFICATE-----\n" + wrapped[0] + "-----END CERTIFICATE-----\n"
    odd = ["caf\xe9 token=abcdef123".encode("latin-1"), token.decode().encode("utf-16-le"), b"\xfe\xff" + token.decode().encode("utf-16-be"), b"\0\1\0\2\0" + token + b"\0"]
    packed = gzip.compress(noise + token)
    texts = [*wrapped, pem, wrapped[0].replace("\n", "\r\n  "), "key: " + wrapped[0] + "Thanks\nand regards", *(base64.b64encode(x).decode() for x in odd)]
    texts += ["http://a.example/?x=1&data=" + quote(packed), "data=" + quote_plus(packed), quote(token.decode().encode("utf-16-le")), "".join(f"\\x{c:02x}" for c in packed)]
    for text in texts:
        assert {s.kind for s in find_all(f"See:\n{text}\n.")[1]} == {"assign"}, text
    assert not find_all(base64.encodebytes(noise).decode())[1]


def test_secret_query_base(spark):
    got = {r["doc_id"]: r for r in queries.op9_secret_scan(spark, DATA).collect()}
    pattern = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
    for r in docs(spark).collect():
        found = [("assign", m.start(), m.end()) for m in pattern.finditer(r["text"]) if len(m[2]) >= 6]
        found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", r["text"]) if len(m[0]) >= 20]
        found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", r["text"]) if len(m[0]) >= 24]
        found.sort(key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


def test_media(spark):
    for raw in (b"", b"a", bytes(range(256)) * 3):
        assert read_png(write_png(pad(raw))).tobytes() == pad(raw) and len(pad(raw)) % 64 == 0 and len(pad(raw)) >= 64
    items = parse_sequence("<p>one<figure><img src='a' alt='x'><figcaption>cap</figcaption></figure>two<script>no</script><img src=b>")
    assert [(x["kind"], x["text"] or x["ref"], x["caption"]) for x in items] == [("text", "one", None), ("media", "a", "cap"), ("text", "two", None), ("media", "b", None)]
    store = media_store(odd(spark), Workspace(spark, "test"), id_col="doc_id", raw_col="text")
    digest = hashlib.sha256(b"").hexdigest()
    pages = spark.createDataFrame([(1, f"<p>t</p><img src='{SCHEME}{digest}'><img src='{SCHEME}{'0' * 64}'>"), (2, None)], "page_id long, html string")
    got = sorted(interleave(pages, media_features(store), id_col="page_id", html_col="html").collect(), key=lambda r: r["position"])
    assert [r["payload_bytes"] for r in got] == [None, 64, None]


def test_media_captions(spark):
    """Captions before their media, several media in a figure, pages without a head's end tag; all pages, in order."""
    pages = [
        "<html><head><title>t</title><meta charset=x><p>one<figure><figcaption>cap</figcaption><img src=a><img src=b alt=own></figure><img src=c alt=c2><figcaption>loose</figcaption>",
        "<figure><img src=d></figure><figure><img src=e><figcaption> f  g </figcaption></figure>tail",
    ]
    got = [[(x["position"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in parse_sequence(p)] for p in pages]
    assert got[0] == [(0, "text", "one", None), (1, "media", "a", "cap"), (2, "media", "b", "cap"), (3, "media", "c", "loose")]
    assert got[1] == [(0, "media", "d", None), (1, "media", "e", "f g"), (2, "text", "tail", None)]
    store = media_store(docs(spark).limit(20), Workspace(spark, "test"), id_col="doc_id", raw_col="text")
    refs = {r["doc_id"]: r["digest"] for r in store.select("doc_id", "digest").collect()}
    real = spark.read.parquet(f"{DATA}/pages.parquet")
    figure = F.concat(F.lit(f"<figure><figcaption>for "), F.col("page_id").cast("string"), F.lit(f"</figcaption><img src='{SCHEME}"), F.element_at(F.array(*map(F.lit, refs.values())), (F.col("page_id") % len(refs)).cast("int") + 1), F.lit("'></figure>"))
    real = real.withColumn("html", F.replace("html", F.lit("</h1>"), F.concat(F.lit("</h1>"), figure)))
    items = collections.defaultdict(list)
    for r in interleave(real, media_features(store), id_col="page_id", html_col="html").collect():
        items[r["page_id"]].append(r)
    digests = list(refs.values())
    for r in real.collect():
        found = sorted(items[r["page_id"]], key=lambda x: x["position"])
        assert [(x["position"], x["kind"], x["text"], x["ref"], x["caption"]) for x in found] == [(x["position"], x["kind"], x["text"], x["ref"], x["caption"]) for x in parse_sequence(r["html"])]
        media = [x for x in found if x["kind"] == "media" and x["payload_bytes"]]
        assert [(x["caption"], x["ref"]) for x in media] == [(f"for {r['page_id']}", SCHEME + digests[r["page_id"] % len(digests)])] * r["html"].count("<figure><figcaption>for ")
        texts = " ".join(x["text"] for x in found if x["kind"] == "text")
        assert re.sub(r"\s", "", re.search(r"<h1>(.*?)</h1>", r["html"], re.S)[1].replace("&amp;", "&"))[:40] in re.sub(r"\s", "", texts)


def test_media_query(spark):
    got = {r["doc_id"]: r for r in queries.op6_media_columns(spark, DATA).collect()}
    for r in docs(spark).collect():
        payload, g = pad(r["text"].encode()), got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(r["text"].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_sentencepiece(spark):
    sp = pytest.importorskip("sentencepiece")
    path = queries.piece_model()
    machine, library = Machine(open(path, "rb").read()), sp.SentencePieceProcessor(model_file=path)
    texts = [r["text"] for r in docs(spark).collect()] + ["", "  ", " a  b ", "\n\nx\ty ", "日本語 😀", "▁a", "a" * 500, "    def f(x):\n  return x**2", "é​"]
    for text in texts:
        ids = machine.encode(text)
        assert ids == library.encode(text)
        assert machine.decode(ids) == text.replace("▁", " ")
    rows = encode_documents(odd(spark), path).collect()
    assert len(rows) == 18 and all(r["ids"] == library.encode(r["decoded"]) for r in rows) and encode_documents(empty(spark), path).count() == 0


def test_sentencepiece_units(spark, monkeypatch):
    """What repeats between characters that no piece joins is composed once, whatever stands beside it."""

    class Counting(Machine):
        composed = 0

        def _only_path(self, word):
            self.composed += 1
            return super()._only_path(word)

    machine = Counting(open(queries.piece_model(), "rb").read())
    texts = [f"{a}\n{b}" for a in WORDS[:40] for b in WORDS[:40]]
    assert len(set(texts)) == 1600
    for text in texts:
        assert machine.decode(machine.encode(text)) == text
    assert machine.composed <= 2 * 40 + 1

    sp = pytest.importorskip("sentencepiece")
    library = sp.SentencePieceProcessor(model_file=queries.piece_model())
    monkeypatch.setattr(sentencepiece_fst, "CHUNK", 50)
    monkeypatch.setattr(sentencepiece_fst, "KEPT_UNITS", 20)
    monkeypatch.setattr(sentencepiece_fst, "KEPT_PAIRS", 20)
    texts = [r["text"] for r in docs(spark).limit(30).collect()] + ["", " ", "", "a" * 300, "日本語 😀 \u2581", " " * 120 + "x", "\x00\n\n é​", ""]
    ids, offs = machine.encode_all(texts)
    data, begins = machine.decode_all(ids, offs)
    for k, text in enumerate(texts):
        assert ids[offs[k] : offs[k + 1]].tolist() == library.encode(text)
        assert data[begins[k] : begins[k + 1]].tobytes().decode() == text.replace("▁", " ")


def test_sentencepiece_pairs():
    """The pair acceptor against merging the joined characters, among scores that repeat and pieces that no merges make."""
    rng = random.Random(5)
    for _ in range(20):
        pieces = dict.fromkeys(["a", "b", "c", *("".join(rng.choices("abc", k=rng.randrange(2, 6))) for _ in range(25))])
        model = b"".join(proto(1, proto(1, p.encode()) + proto(2, -float(rng.randrange(12))) + proto(3, 1)) for p in pieces) + proto(2, proto(3, 2))
        machine = Machine(model)

        def merged(symbols):
            while found := [(-machine.scores[machine.arcs[x + y]], i) for i, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)) if x + y in machine.arcs]:
                i = min(found)[1]
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            return symbols

        for a, i in machine.arcs.items():
            for b, j in machine.arcs.items():
                assert machine._together(i, j) == (merged(list(a + b)) == [a, b]), (a, b)
        for _ in range(40):
            text = "".join(rng.choices("abcx", weights=(3, 3, 3, 1), k=30))
            assert machine._only_path(text) == [machine.arcs.get(x, machine.unknown) for x in merged(list(text))]
            assert machine.encode(text)[1:] == machine._only_path(text)


def proto(number, value):
    """A field of a protocol-buffer message."""
    import struct

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    return varint(number << 3 | 5) + struct.pack("<f", value) if isinstance(value, float) else varint(number << 3) + varint(value)


def unigram_model(pieces, rules=None, byte_fallback=False, prefix=True):
    """A model file of pieces (text, score, type) and a public rule set's character map."""
    sp = pytest.importorskip("sentencepiece")
    out = b"".join(proto(1, proto(1, p.encode()) + proto(2, float(s)) + proto(3, t)) for p, s, t in pieces)
    out += proto(2, proto(3, 1) + proto(35, int(byte_fallback)))
    spec = proto(1, b"own") + proto(3, int(prefix)) + proto(4, 1) + proto(5, 1)
    if rules:
        from larkspur.llm.sentencepiece_fst import _fields

        given = sp.SentencePieceNormalizer(rule_name=rules).serialized_model_proto()
        spec += proto(2, dict(_fields(dict(_fields(given))[3]))[2])
    return out + proto(3, spec)


def test_unigram_machine():
    model = unigram_model([("<unk>", 0, 2), ("▁", -3, 1), ("a", -2, 1), ("b", -2, 1), ("ab", -3, 1), ("▁a", -1, 1)])
    assert Machine(model).encode("ab") == [5, 3]  # ▁a b costs 3, ▁ ab costs 6


@pytest.mark.parametrize("rules,byte_fallback", [(None, False), ("nmt_nfkc", False), ("nfkc_cf", True), ("nmt_nfkc_cf", True)])
def test_unigram_against_library(spark, rules, byte_fallback):
    """Shortest paths over scored pieces, character maps, unknown characters and bytes: ids as the library's."""
    sp = pytest.importorskip("sentencepiece")
    rng = random.Random(12)
    texts = [r["text"][:3000] for r in docs(spark).limit(60).collect()]
    counts = collections.Counter()
    for x in texts:
        for word in x.split()[:80]:
            word = "▁" + word
            counts.update(word[i : i + n] for i in range(len(word)) for n in (2, 3, 4, 5) if "▁" not in word[i + 1 : i + n])
    common = [p for p, n in counts.most_common(1500) if len(p) > 1]
    letters = sorted(set("".join(common)) - {"é"})
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{i:02X}>", 0, 6) for i in range(256) if byte_fallback]
    pieces += [(p, -rng.uniform(2, 12), 1) for p in dict.fromkeys([*letters, *common, "▁"])]
    model = unigram_model(pieces, rules, byte_fallback)
    machine, library = Machine(model), sp.SentencePieceProcessor(model_proto=model)
    odd_texts = ["", " ", "ﬁne ①②  ｆｕｌｌ ｗｉｄｔｈ", "A\u0301B\u200b C\tD\n\nE", "日本語 😀😀 x", "é" * 5 + "e\u0301", "½ ™ Ⅷ ㌔", "a  b   c ", "\u00a0x\u3000y", "x" * 300]
    for text in texts + odd_texts:
        assert machine.encode(text) == library.encode(text), text[:80]
        assert machine.decode(machine.encode(text)) == library.decode(machine.encode(text)).replace(" ⁇ ", "") or not byte_fallback


def brute_leaks(text, item, run=4):
    """Coverage of an item: the longest common token run that uses free tokens only is marked, again and again."""
    x, y = (re.findall(r"\w+", z.lower()) for z in (text or "", item or ""))
    least, used_x, used_y, tiles = min(run, len(y)), set(), set(), 0
    while y:
        best = (0, 0, 0)
        for p in range(len(x)):
            for t in range(len(y)):
                n = 0
                while p + n < len(x) and t + n < len(y) and x[p + n] == y[t + n] and p + n not in used_x and t + n not in used_y:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            break
        used_x.update(range(p, p + n))
        used_y.update(range(t, t + n))
        tiles += 1
    return (len(used_y) / len(y), tiles) if y else (0.0, 0)


def test_decontaminate(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")
    texts = [
        f"x {item} y", "seven eight nine ten eleven twelve and one two three four five six", "one two three four only", None, "", "a Tiny, item!", "one two three x four five six y seven eight nine", item + " " + item,
    ]
    rows = [(i, x, 1) for i, x in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0], (None, item, 2), (None, "clean", 2)], "doc_id long, text string, coverage int")
    got = collections.Counter((r["doc_id"], r["item_id"], r["coverage"]) for r in find_leaks(df, bench).collect())
    assert got == {(0, 1, 1.0): 2, (1, 1, 1.0): 1, (5, 4, 1.0): 1, (7, 1, 1.0): 1, (None, 1, 1.0): 1}
    kept = drop_leaks(df, bench)
    assert kept.schema == df.schema and sorted((r["doc_id"] or -1, r["coverage"]) for r in kept.collect()) == [(-1, 2), (2, 1), (3, 1), (4, 1), (6, 1)]
    assert find_leaks(df, bench.limit(0)).count() == 0 and find_leaks(empty(spark), bench).count() == 0 and drop_leaks(df, bench.limit(0)).count() == 11


def test_tiling_against_brute_force(spark):
    """Reordered, cut and mixed passages over few words, so that runs repeat and overlap."""
    rng = random.Random(8)
    words = ["aa", "bb", "Cc", "dd", "e9", "é"]
    items = [" ".join(rng.choices(words, k=rng.choice((1, 2, 3, 9, 14)))) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choices(words, k=rng.randrange(1, 6)))]
        for _ in range(rng.randrange(3)):
            tokens = rng.choice(items).split()
            a = rng.randrange(len(tokens))
            parts.append(" ".join(tokens[a:] + tokens[:a]))
        rng.shuffle(parts)
        texts.append(", ".join(parts))
    docs_, bench = (spark.createDataFrame(list(enumerate(x)), f"{n} string, text string") for x, n in ((texts, "doc_id"), (items, "item_id")))
    got = {(r["doc_id"], r["item_id"]): (round(r["coverage"], 9), r["n_tiles"]) for r in find_leaks(docs_, bench).collect()}
    want = {(str(i), str(j)): brute_leaks(x, y) for i, x in enumerate(texts) for j, y in enumerate(items)}
    assert got == {k: (round(c, 9), n) for k, (c, n) in want.items() if c >= 0.5 and n}


def test_language_id(spark):
    got = identify(docs(spark), text=F.col("text"), declared=F.col("lang"), host=F.col("source")).collect()
    assert sum(r["_language"] == r["lang"] for r in got) >= 0.99 * len(got) and all(r["_accepted"] for r in got)
    wrong = docs(spark).withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "es").when(F.col("doc_id") % 10 == 1, None).otherwise(F.col("lang")))
    truth = {r["doc_id"]: r["lang"] for r in docs(spark).collect()}
    got = identify(wrong, text=F.col("text"), declared=F.col("lang"), host=F.col("source")).collect()
    assert sum(r["_language"] == truth[r["doc_id"]] for r in got) >= 0.97 * len(got)
    got = identify(odd(spark), text=F.col("text"), declared=F.col("lang"), host=F.col("source")).collect()
    assert len(got) == 18 and {r["_accepted"] for r in got if not (r["text"] or "").strip()} == {False}
    assert identify(empty(spark), text=F.col("text"), declared=F.col("lang"), host=F.col("source")).count() == 0
    assert spark.range(1).select(address_host(F.lit("https://u@A.B.example.org:80/x"))).first()[0] == "a.b.example.org"


FOREIGN = [
    "Быстрая коричневая лиса перепрыгивает через ленивую собаку, а потом возвращается домой к своим детям и ест рыбу у реки",
    "Hızlı kahverengi tilki tembel köpeğin üzerinden atlar ve sonra evine dönüp çocuklarıyla birlikte ırmağın kıyısında balık yer",
    "qxzv kjwq zxqk vvwx qqzx jkxw zzqv xkqj wvxz qjzk xwqv kzjx vqxw zjkq xvzw qkjx wzvq xjqz kvwx zqjk",
    "Szybki brązowy lis przeskakuje nad leniwym psem, a potem wraca do domu i je ryby z dziećmi nad brzegiem rzeki",
]


def test_language_background(spark):
    """Texts in none of the modelled languages are not accepted; those in one are, whatever else is missing."""
    base = docs(spark).select("text", "lang", "source")
    df = base.unionByName(spark.createDataFrame([(x, None, "src0") for x in FOREIGN], base.schema))
    got = {r["text"]: r for r in identify(df, text=F.col("text"), declared=F.col("lang"), host=F.col("source")).collect()}
    assert [got[x]["_accepted"] for x in FOREIGN] == [False] * len(FOREIGN)
    assert all(r["_accepted"] for x, r in got.items() if x not in FOREIGN)
    odd_names = base.limit(3).withColumns({"_text": F.lit("mine"), "_host": F.lit(1)})
    assert {r["_text"] for r in identify(odd_names, text=F.col("text"), declared=F.col("lang"), host=F.col("source")).collect()} == {"mine"}
    with pytest.raises(ValueError):
        identify(base.withColumn("_language", F.lit(1)), text=F.col("text"), declared=F.col("lang"), host=F.col("source"))


def test_language_evidence_against_brute_force(spark):
    """Smoothed tables of declarations, suffixes and hosts, and their posterior, recomputed row by row."""
    import math

    from larkspur.llm import language_id as L

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    e = L.page_evidence(F.col("html"), F.col("url"))
    df = pages.select("page_id", e["text"].alias("text"), F.when(F.col("page_id") % 7 == 0, None).otherwise(e["declared"]).alias("declared"), e["host"].alias("host"))
    rows = df.collect()
    got = {r["page_id"]: r for r in identify(df, text=F.col("text"), declared=F.col("declared"), host=F.col("host")).collect()}
    langs = sorted({r["declared"].split("-")[0].lower() for r in rows if r["declared"]})
    assert {"en", "fr"} <= set(langs) and all("." in r["host"] for r in rows)
    import numpy as np

    counts, letters = np.full((len(langs), L.BINS), 0.5), np.full(256, 0.5)
    grams = {}
    for r in rows:
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        grams[r["page_id"]] = (raw, *L.trigrams(raw, np.array([0, len(raw)])))
        letters += np.bincount(L.folded(raw)[0], minlength=256)
        if r["declared"]:
            np.add.at(counts[langs.index(r["declared"].split("-")[0].lower())], grams[r["page_id"]][1], 1)
    table, single = np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(letters / letters.sum())
    ll = {}
    for i, (raw, bins, _, at) in grams.items():
        p = single[L.folded(raw)[0]]
        ll[i] = L.TEMPER * np.append(table[:, bins].sum(axis=1), np.logaddexp(p[at] + p[at + 1] + p[at + 2], -math.log(L.BINS)).sum() - len(at) * math.log(2))
    shown = {r["page_id"]: int(ll[r["page_id"]].argmax()) for r in rows if len(grams[r["page_id"]][1])}
    shown = {i: k for i, k in shown.items() if k < len(langs)}
    tally = lambda key: collections.Counter((key(r), shown[r["page_id"]]) for r in rows if r["page_id"] in shown)
    n = np.array([sum(v == k for v in shown.values()) for k in range(len(langs))], float)
    up = lambda h: re.sub(r"^[^.]*\.(?=[^.]*\.)", "", h)
    dec, suf, hosts, tops = tally(lambda r: (r["declared"] or "").split("-")[0].lower()), tally(lambda r: r["host"].split(".")[-1]), tally(lambda r: r["host"]), tally(lambda r: up(r["host"]))
    vec = lambda t, v: np.array([t[v, k] for k in range(len(langs))], float)
    smooth = lambda v, over: (v + L.PRIOR_ROWS * over) / (v.sum() + L.PRIOR_ROWS)
    root = (n + 1) / (n + 1).sum()
    for r in rows:
        lp = ll[r["page_id"]] + np.log(np.append(smooth(vec(hosts, r["host"]), smooth(vec(tops, up(r["host"])), root)) * (1 - L.BACKGROUND), L.BACKGROUND))
        for t, v in ((dec, (r["declared"] or "").split("-")[0].lower()), (suf, r["host"].split(".")[-1])):
            share = vec(t, v).sum() / n.sum()
            lp = lp + (np.log(np.append((vec(t, v) + L.PRIOR_ROWS * share) / (n + L.PRIOR_ROWS), share)) if v else 0)
        best = int(lp.argmax())
        assert got[r["page_id"]]["_language"] == (langs[best] if best < len(langs) else "und")
        assert abs(got[r["page_id"]]["_confidence"] - 1 / np.exp(lp - lp.max()).sum()) < 1e-6


def test_many_languages(spark):
    """Every declared language is modelled, however many there are and however rare they are."""
    rng = random.Random(4)
    words = {f"x{n:02d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(30)] for n in range(70)}
    rows = [(lang, lang if i else None, " ".join(rng.choices(words[lang], k=40))) for n, lang in enumerate(words) for i in range(3 + (n < 64))]
    df = spark.createDataFrame(rows, "truth string, lang string, text string")
    got = identify(df, text=F.col("text"), declared=F.col("lang"), host=F.lit("h")).collect()
    assert len(got) == len(rows) and all(r["_language"] == r["truth"] and r["_accepted"] for r in got)


def test_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = {r["doc_id"]: r for r in queries.op8_quality_pu(spark, "/root/testdata/sf0.01").collect()}
    held = [(both[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if both[r["doc_id"]]["held_out"]]
    assert sum(p == q for p, q in held) >= 0.9 * len(held)
    assert all(both[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in both)
    model = train(docs(spark), labels, id_col="doc_id", text_col="text", label_col="quality")
    assert all(0 <= r["score"] <= 1 for r in score_quality(odd(spark), model).collect()) and score_quality(empty(spark), model).count() == 0
    none = train(empty(spark), labels, id_col="doc_id", text_col="text", label_col="quality")
    assert not none.weights.any() and len({r["score"] for r in score_quality(odd(spark), none).collect()}) == 1
    twice = train(docs(spark).union(docs(spark)), labels.union(labels), id_col="doc_id", text_col="text", label_col="quality")
    assert (twice.weights == model.weights).all() and twice.offset == model.offset


def test_class_prior():
    import numpy as np

    from larkspur.llm.quality_pu import estimate_prior

    rng = np.random.default_rng(2)
    for true in (0.2, 0.5, 0.9):  # margins of two normal classes, calibrated where both are equally frequent
        x = np.concatenate([rng.normal(1.5, 1, int(20000 * true)), rng.normal(-1.5, 1, int(20000 * (1 - true)))])
        assert abs(estimate_prior(1 / (1 + np.exp(-3 * x)), 0.5) - true) < 0.02


def test_chat(spark):
    rows = [
        (1, 0, "user", "The first question here.\nAnother line to quote."), (1, 1, "assistant", "First answer line.\nSecond answer line."), (1, 2, "user", "On Monday, bot wrote:\n> First answer line.\n>> The first question here.\n\nThanks"),
        (1, 3, "user", "> Another line to QUOTE.\nWhat about this?"), (1, 4, None, "plain"), (1, 4, "user", "same turn"), (2, 5, "user", None), (None, 1, "user", "x"), (2, None, "user", ""),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = {(r["conv_id"], r["turn"], r["body"]): r for r in thread_conversations(df).collect()}
    assert len(got) == len(rows)
    one = {t: r for (c, t, _), r in got.items() if c == 1}
    assert {t: r["parent_turn"] for t, r in one.items()} == {0: None, 1: 0, 2: 1, 3: 0, 4: 3} and {t: r["depth"] for t, r in one.items()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 2}
    assert {t: r["branch_turn"] for t, r in one.items()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    assert one[2]["body"] == "Thanks" and one[2]["n_quoted"] == 2 and one[2]["n_linked"] == 2 and one[3]["body"] == "What about this?"
    assert thread_conversations(df.limit(0)).count() == 0
    odd_rows = spark.createDataFrame([("c", 1, "user", "Yes."), ("c", 2, "user", "No, wait. " * 3000), ("c", 3, "user", "> Yes.\nOk"), ("c", 4, "user", "> ...\n>> \n>"), ("c", 5, "user", "> no wait\n>\n> never said")], "conv_id string, turn int, role string, text string")
    got = {r["turn"]: r for r in thread_conversations(odd_rows).collect()}
    assert {t: (r["parent_turn"], r["n_quoted"], r["n_linked"]) for t, r in got.items()} == {1: (None, 0, 0), 2: (1, 0, 0), 3: (1, 1, 1), 4: (3, 3, 0), 5: (2, 1, 1)}


def test_planted_quotes(spark):
    """Replies quote rewrapped sentences of one earlier message, and what that one quoted, before or after their own text."""
    import textwrap

    rng = random.Random(11)
    rows, want = [], {}
    for c in range(6):
        bodies, quoted = [], []
        for t in range(25):
            body = [" ".join(rng.choices(WORDS, k=rng.randrange(3, 15))).capitalize() + rng.choice(".!?") for _ in range(4)]
            text, mine, src = "\n".join((" ".join(body[:2]), "", *body[2:])), [], None
            if t and rng.random() < 0.8:
                src = rng.randrange(t)
                a = rng.randrange(4)
                mine = textwrap.wrap(" ".join(bodies[src][a : a + 2]), rng.choice((25, 40, 200)))
                quote = [f"> {x}" for x in mine] + [f">> {x}" for x in quoted[src][:3]]
                text = "\n".join(("Bot wrote:", *quote, "", text) if rng.random() < 0.5 else (text, *quote))
            bodies.append(body)
            quoted.append(mine)
            rows.append((c, t, rng.choice(("user", "assistant")), text))
            want[c, t] = (src if src is not None else t - 1 if t else None, (src is not None) + (src is not None and bool(quoted[src])))
    threads = thread_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    got = {(r["conv_id"], r["turn"]): r for r in threads.collect()}
    assert {k: (r["parent_turn"], r["n_quoted"]) for k, r in got.items()} == want and all(r["n_quoted"] == r["n_linked"] and ">" not in r["body"] for r in got.values())
    from larkspur.llm.chat_quotes import assemble_conversations

    parts = assemble_conversations(threads).collect()
    placed = {(p["conv_id"], m["turn"]): (p["branch_turn"], p["part"], k) for p in parts for k, m in enumerate(p["messages"])}
    assert len(placed) == len(rows) and all(placed[c, p] < placed[c, t] for (c, t), (p, _) in want.items() if p is not None)
    assert all(p["chat"] == "".join(got[p["conv_id"], m["turn"]]["chat"] for m in p["messages"]) for p in parts)


@pytest.mark.parametrize("turns", [3, 256])
def test_chat_blocks(spark, monkeypatch, turns):
    """Depth and branch of long conversations against the chains of parents, followed one by one."""
    from larkspur.llm import chat_quotes

    monkeypatch.setattr(chat_quotes, "TURNS", turns)
    rng = random.Random(5)
    rows = [(c, 2 * t, "user", (f"> line number {2 * rng.randrange(t)} of {c}\n" if t and rng.random() < q else "") + f"line number {2 * t} of {c}") for c, n, q in (("a", 90, 0.5), ("b", 70, 0.0), ("c", 40, 1.0)) for t in range(n)]
    got = {(r["conv_id"], r["turn"]): r for r in thread_conversations(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert len(got) == len(rows)
    first = {}
    for c, t in sorted(got):
        first.setdefault((c, got[c, t]["parent_turn"]), t)
    for c, t, _, text in rows:
        quoted = re.match(r"> line number (\d+)", text)
        parent = int(quoted[1]) if quoted else t - 2 if t else None
        up = got[c, parent] if parent is not None else None
        assert got[c, t]["parent_turn"] == parent
        assert got[c, t]["depth"] == (up["depth"] + 1 if up else 0)
        assert got[c, t]["branch_turn"] == (up["branch_turn"] if up and first[c, parent] == t else t)


def test_pipeline(spark):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    all_docs = {r["doc_id"]: r for r in docs(spark).collect()}
    held = collections.defaultdict(set)
    for i, r in all_docs.items():
        for x in r["text"].split("\n"):
            held[key(x)].add(i)
    cleaned = [(i, "\n".join(x for x in r["text"].split("\n") if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == i)) for i, r in all_docs.items()]
    part = brute_near(cleaned, 5, (80, 100))
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    left = spark.createDataFrame([(i, x) for i, x in cleaned if part[i] == i], "doc_id long, text string")
    leaked = {r["doc_id"] for r in find_leaks(left, bench).collect()}
    assert set(got) == {r["doc_id"] for r in left.collect()} - leaked
    texts = dict(cleaned)
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in got.items())
