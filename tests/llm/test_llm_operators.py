"""The training-data operators against plain versions, and their defined edge cases."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from conftest import SF
from tidemark.llm import audio, binary, bpe, html, jaccard, language, packing, quality, queries, quoting, tokens, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    rows = [
        (1, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1), (2, None, None, None, None), (3, "", "en", None, 0),
        (None, "a text without id but with some words in it", "en", "a", 2), (4, " \t\n ", None, "b", 4), (5, long, "en", "a", 5), (6, long, "de", "b", 5), (7, "12345 678", "fr", "c", 1),
        (8, "ONE two Three four FIVE six", "en", "a", 1),
    ]
    extra = ("score", "row", "node", "n", "bin", "ids", "words", "parent", "h", "key", "mark", "a", "b")
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit("x").alias(c) for c in extra])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def utf8(text):
    return (text or "").encode()


# --- 1


def test_audio_round_trip(docs, odd, none):
    for df in (docs, odd):
        texts = sorted((utf8(r.text) for r in df.select("text").collect()))
        stored = audio.features(df)
        got = {r.payload_sha256: r for r in audio.read_back(stored).collect()}
        raw = stored.collect()
        assert sorted(r.n_bytes for r in raw) == sorted(map(len, texts))
        for m in raw:
            rate, back = audio.read_wav(bytes(m.media))
            r = got[hashlib.sha256(back).hexdigest()]
            assert rate == audio.RATE and len(back) % 64 == 0 and len(back) == r.payload_bytes > 0
            assert zlib.crc32(back[-64:]) == r.tail_crc32 and len(m.media) == r.media_bytes
            assert hashlib.sha256(bytes(m.media)).hexdigest() == r.media_sha256 and back[: m.n_bytes] in texts
            mel, energy = audio.log_mel(back)
            runs = audio.energy_segments(energy)
            table = pa.ipc.open_stream(bytes(m.tensors)).read_all()
            assert r.feature.startswith(f"frames={len(mel)};tensors={-(-len(mel) // audio.FRAMES)};segments={len(runs)};voiced={sum(b - a for a, b in runs)};")
            kept = table["log_mel"].combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)
            assert np.allclose(kept[: len(mel)], mel, atol=0.01) and (kept[len(mel) :] == -6).all()
    assert table.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float16(), (audio.FRAMES, audio.MELS))
    assert all(a < b for a, b in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist()))
    assert audio.round_trip(none).count() == 0


def test_log_mel_equals_plain():
    rng = np.random.default_rng(6)
    samples = rng.integers(0, 256, 1280, dtype=np.uint8).tobytes()
    mel, _ = audio.log_mel(samples)
    x = np.frombuffer(samples, np.uint8) / 128 - 1
    y = audio.resample(x.astype(np.float32), 0, len(x) * audio.UP // audio.DOWN).astype(np.float64)
    top = 2595 * np.log10(1 + audio.RATE_OUT / 2 / 700)
    edge = [700 * (10 ** (top * k / (audio.MELS + 1) / 2595) - 1) for k in range(audio.MELS + 2)]
    for f in range(len(mel)):
        part = [y[f * audio.HOP + n] * (0.5 - 0.5 * np.cos(2 * np.pi * n / audio.SIZE)) for n in range(audio.SIZE)]
        for m in range(audio.MELS):
            total = 0.0
            for k in range(129):
                hz = k * audio.RATE_OUT / 256
                w = max(0.0, min((hz - edge[m]) / (edge[m + 1] - edge[m]), (edge[m + 2] - hz) / (edge[m + 2] - edge[m + 1])))
                if w and f < 3:
                    total += w * abs(sum(v * np.exp(-2j * np.pi * k * n / 256) for n, v in enumerate(part))) ** 2
            assert f >= 3 or abs(np.log10(total + 1e-6) - mel[f, m]) < 1e-3


def test_audio_signal():
    t = np.arange(8000) / 8000
    x = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    y = audio.resample(x, 0, 6000)
    assert np.abs(y[100:-100] - np.sin(2 * np.pi * 440 * np.arange(6000) / 6000)[100:-100]).max() < 0.02
    assert np.allclose(audio.resample(x, 1000, 500), y[1000:1500], atol=1e-6)
    energy = np.array([0, 0, 9, 5, 9, 0, 0, 4, 0], np.float32)
    assert audio.energy_segments(energy) == [(2, 5)]
    assert audio.energy_segments(np.zeros(5, np.float32)) == []


# --- 2


def plain_counts(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts():
    r = random.Random(2)
    for _ in range(300):
        t = "".join(r.choice(["a", "b", " ", " ", "\n", "é", "#", "\t", "\x85", "\xa0"]) for _ in range(r.randint(0, 200)))
        assert quality.count(t)[:5] == plain_counts(t)


def test_quality_rules(docs, odd, none):
    got = quality.judge(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        n, chars, symbols, dup, rep = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and not (r.base_failed and r.kept)
    fine = [r for r in got if not r.base_failed]
    assert 0.7 * len(fine) < sum(r.kept for r in fine) < len(fine)
    edge = quality.judge(odd).collect()
    assert len(edge) == 10 and all(r.base_failed for r in edge if r.n_words == 0)
    assert quality.judge(none).count() == 0


def test_sketches_merge(spark):
    rng = np.random.default_rng(0)
    rows = [("en", f"s{i % 3}", int(n), 10, 0, 0, 0, 0, False) for i, n in enumerate(rng.integers(20, 60, 3000))]
    df = spark.createDataFrame(rows, "lang string, source string, word_chars bigint, n_words bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_stutters bigint, base_failed boolean")
    one = quality.sketches(df)
    two = quality.sketches(df.repartition(7)).groupBy("lang", "source", "ratio", "bucket").agg(F.sum("n").alias("n"))
    assert one.exceptAll(two).count() == 0
    q = quality.quantiles(one, ["lang"]).filter("ratio = 'long_words'").first()
    exact = np.quantile([r[2] / 10 for r in rows], [0.5, 0.9])
    assert abs(q.q50 / exact[0] - 1) < 0.03 and abs(q.tail / exact[1] - 1) < 0.03


def test_kept_equals_plain(docs):
    """The verdict from sorted values of whole groups instead of sketches, up to a bucket's width."""
    got = quality.judge(docs).collect()
    value = {
        "symbols": lambda r: r.n_symbols / r.n_words, "dup_lines": lambda r: 10 * r.n_dup_lines / r.n_words, "repeats": lambda r: r.n_repeat_words / r.n_words,
        "stutters": lambda r: r.n_stutters / r.n_words, "long_words": lambda r: r.word_chars / r.n_words, "short_words": lambda r: 20 * r.n_words / r.word_chars,
    }
    fine = [r for r in got if not r.base_failed]

    def fence(rows, k):
        v = sorted(value[k](r) if value[k](r) > quality.LEAST else 0.0 for r in rows)
        at = lambda rank: v[max(rank, 1) - 1]
        q50, tail = at(-(-len(v) // 2)), at(int(np.ceil(len(v) * quality.TAIL)))
        some = [x for x in v if x]
        return tail + quality.FENCE * (tail - q50) if tail else some[max(1, int(np.ceil(len(some) * quality.SPARSE[k]))) - 1] if some else np.inf

    def top(r, k):
        for same in (lambda x: (x.lang, x.source) == (r.lang, r.source), lambda x: x.lang == r.lang, lambda x: True):
            rows = [x for x in fine if same(x)]
            if len(rows) >= quality.LEAST_ROWS:
                break
        return fence(rows, k)

    tops, sure = {}, 0
    for r in fine:
        for k in value:
            if (r.lang, r.source, k) not in tops:
                tops[(r.lang, r.source, k)] = top(r, k)
        share = [value[k](r) / tops[(r.lang, r.source, k)] for k in value]
        if all(s < 0.9 for s in share) or any(s > 1.1 for s in share):
            sure += 1
            assert r.kept == all(s < 0.9 for s in share)
    assert sure > 0.5 * len(fine) and len({round(v, 3) for v in tops.values()}) >= 6


def test_quality_fences_adapt(spark):
    rng = np.random.default_rng(1)

    def text(long, extra):
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(long - 1, long + 2))) for _ in range(100)]
        return " ".join(words + words[:extra])

    rows = [(f"{lang}{i}", text(n, 0), lang, "s") for lang, n in (("xx", 4), ("yy", 8)) for i in range(300)]
    rows += [("long", text(8, 0), "xx", "s"), ("short", text(4, 0), "yy", "s"), ("again", text(4, 14), "xx", "s")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")).collect()}
    # Words of the other language's length fail, and so does repetition that the base rule (30 %) lets pass.
    assert not any(got[k].base_failed or got[k].kept for k in ("long", "short", "again"))
    assert sum(r.kept for r in got.values()) > 590


# --- 3 and 9


def plain_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(plain_ids, "lib"):
        plain_ids.lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return plain_ids.lib.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_word_cache_equals_library():
    own, r = tokens.WordTokenizer(tokens.default_path()), random.Random(3)
    fixed = ["<|endoftext|>x", "İstanbul ΣΑΣ", "é ́x", "it's we'LL", "ﬁ x３", "", "a\x85b\x1cc"]
    for t in fixed + ["".join(r.choice("abZ.,'éÀß×÷ñÿ€́İ1 \n<|") for _ in range(r.randint(0, 12))) for _ in range(2000)]:
        assert own.encode(t) == struct.pack(f"<{len(plain_ids(t))}I", *plain_ids(t))


def test_packing(docs, odd, none):
    for df in (docs, odd):
        got = packing.pack(df).collect()
        want = Counter()
        for r in df.collect():
            ids = [*plain_ids(r.text), 0]
            want.update((r.doc_id, k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])) for k in range(0, len(ids), 2048))
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for places in bins.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= 2048
        least = -(-sum(r.length for r in got) // 2048)
        assert len(bins) <= 1.02 * least + 1
    assert packing.pack(none).count() == 0


def test_best_fit_takes_the_tightest_bin():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
    r = random.Random(1)
    sizes = sorted((r.randint(1, 2048) for _ in range(3000)), reverse=True)
    bins = packing.best_fit(sizes)
    assert sorted(i for b in bins for i in b) == list(range(3000)) and all(sum(sizes[i] for i in b) <= 2048 for b in bins)


def test_binary_round_trip(docs, odd, none):
    for df in (docs, odd):
        got = binary.round_trip(df).collect()
        rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(
            (r.doc_id is not None, r.doc_id or 0, len(ids := [*plain_ids(r.text), 2]), crc(ids)) for r in rows
        )
        total = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == total
            total += r.n_tokens
        order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
        assert order == sorted(order)
    assert binary.round_trip(none).count() == 0


def test_binary_reader_finds_documents_and_damage(tmp_path):
    path = tmp_path / "x.zst"
    with path.open("wb") as f:
        out = binary.Writer(f)
        for k in range(50):
            out.add(k // 2, struct.pack("<3I", k, k, k))
        out.close()
    source = pa.OSFile(str(path))
    reader = binary.Reader(source)
    assert reader.find(7) == [struct.pack("<3I", k, k, k) for k in (14, 15)] and reader.find(99) == []
    assert [i for i, _ in reader.scan(64)] == [k // 2 for k in range(50)]
    raw = bytearray(path.read_bytes())
    raw[int(reader.start[3]) + 8] ^= 1
    path.write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017  zstandard or checksum
        binary.Reader(pa.OSFile(str(path))).document(3)


# --- 4


def test_html_cases(spark):
    page = """<!DOCTYPE html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>
      <div class="ad">Buy this now</div><article><h1>Head &amp; tail</h1><p><b>First   para&#8217;s<br>text<p>Second</p></article>
      <div id="comments"><p>I think that this is a very long comment by a reader that is not a part of the text</p></div><footer>&copy; me</footer>"""
    assert html.extract(page) == "Head & tail\nFirst para’s text\nSecond"
    bare = """<body><div class=menu><a href=x>Home</a> <a>About</a></div><div><h2>A head</h2><p>Some longish text about a thing that goes on for quite a while, yes.
      <p>And a second paragraph of the same kind, which is long enough as well.</div><aside>Also read this</aside><form>Name <input> Send me the newsletter please, it is very good</form><div class="footer">2020</div>"""
    assert html.extract(bare).split("\n") == ["A head", "Some longish text about a thing that goes on for quite a while, yes.", "And a second paragraph of the same kind, which is long enough as well."]
    assert [html.extract(x) for x in (None, "", "<p>", "<script>x", "<!-- a")] == [""] * 5
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", "<p>" + "long text " * 50_000)]
    got = html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and max(r.n_chars for r in got) == 499_999
    assert html.stretches([0, 0, 50, 40, 0, 0, 0, 90], 3, 60) == [(2, 4), (7, 8)]


def test_html_articles(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        import html as entities

        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p)>", inside)]
        assert html.extract(r.html) == "\n".join(filter(None, blocks))


def test_html_story_outside_articles():
    story = ["A story in a plain element, which is far longer than each of the cards.", "It goes on for a second paragraph of this kind, and ends here."]
    cards = "".join(f"<article><h3><a href=x>Card {i}</a></h3><p>Teaser {i}</p></article>" for i in range(9))
    lead = "<div>" + "".join(f"<p>{x}</p>" for x in story) + "</div>"
    gap = "<ul>" + "<li><a href=x>Next</a></li>" * 4 + "</ul>"
    for page in (f"<body>{lead}{gap}<article><p>One item</p></article></body>", f"<body><article><p>One item</p></article>{gap}{lead}</body>"):
        assert html.extract(page) == "\n".join(story)
    assert set(story) <= set(html.extract(f"<body>{lead}{cards}</body>").split("\n"))
    # A marked article that holds more than what stands around it stays the text.
    assert html.extract(f"<body><p>{story[0]}</p>{gap}<main>{lead}<p>More.</p></main></body>") == "\n".join([*story, "More."])


def test_html_names_that_hide_nothing():
    for wrap in ("class='overflow-hidden'", "aria-hidden='false'", "data-hidden-x", "title='hidden gems'", "class='with-sidebar'"):
        assert html.extract(f"<body><div {wrap}><article><p>Text of it.</p></article></div></body>") == "Text of it.", wrap
    for part in ("<h2 id='related-work'>A</h2>", "<h2 id='search'>A</h2>", "<h2 class='banner'>A</h2>", "<div class='share-of-voice'>A</div>", "<div id='search'>A</div>", "<p id='notice'>A</p>"):
        assert html.extract(f"<article><p>Text.</p>{part}</article>") == "Text.\nA", part
    for part in ("<div hidden>A</div>", "<p aria-hidden=true>A</p>", "<div style='display: none'>A</div>", "<div class='share-buttons'>A</div>", "<div class='x post-comments' id=c>A</div>", "<div id='comments'>A</div>"):
        assert html.extract(f"<article><p>Text.</p>{part}</article>") == "Text.", part


def test_html_keeps_the_end():
    long = "A paragraph of the story that is long enough to be the text of a page. " * 8
    page = f"<body><div><h1>Head</h1><p>{long}</p>" + "<p><a href=x>See this</a></p>" * 3 + "<p>The closing words.</p></div><div>2020</div></body>"
    assert html.extract(page).split("\n") == ["Head", long.strip(), *["See this"] * 3, "The closing words."]


# --- 5 and 7


def test_language(docs, odd, none):
    model = language.train(docs, per_lang=100)
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    edge = {r.text: r for r in language.identify(odd, model, ident="text").select("text", F.col("lang_pred").alias("p"), F.col("score").alias("s")).collect()}
    assert edge[None].p == edge[""].p == edge["12345 678"].p == "und"
    assert language.identify(none, language.train(none)).count() == 0
    assert language.identify(docs, language.train(none)).filter("lang_pred <> 'und'").count() == 0


def test_every_labelled_language_is_learned(spark):
    rng = random.Random(5)
    rows = []
    for n in range(70):
        words = ["".join(chr(0x4E00 + 40 * n + rng.randrange(40)) for _ in range(3)) for _ in range(12)]
        rows += [(100 * n + i, " ".join(rng.choices(words, k=20)), f"l{n}") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(df, per_lang=4, landmarks=140)
    assert model.langs == sorted({lang for *_, lang in rows})
    got = language.identify(df, model, ident="lang").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(got)
    assert len(language.labelled_sample(df, 4, 10_000, 10_000)) == 4 * 70
    assert len(language.labelled_sample(df, 4, 70, 10_000)) == len(language.labelled_sample(df, 4, 10_000, 1)) == 70


def test_language_sample_is_bounded_for_one_id(spark):
    rows = [(1, f"some words number {k}", "en") for k in range(3000)] + [(2, "quelques mots", "fr")] * 50
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = Counter(lang for lang, _ in language.labelled_sample(df, 10, 1000, 1_000_000))
    assert got == {"en": 10, "fr": 10}


def test_ridge_equals_plain():
    rng = random.Random(3)
    alphabets = ("abcdef", "defghi", "ghijkl")
    sample = [(f"l{k % 3}", "".join(rng.choices(alphabets[k % 3] + " ", k=40))) for k in range(30)]
    model = language.fit(sample, landmarks_per_lang=5)
    marks = [t for lang in range(3) for t in [t for own, t in sample if own == f"l{lang}"][:5]]
    marks.sort(key=[t for _, t in sample].index)
    k, m = (model.kernel(x, language.Grams()).astype(np.float64) for x in ([t for _, t in sample], marks))
    y = np.array([[1.0 if lang == own else -1.0 for own in model.langs] for lang, _ in sample])
    want = np.linalg.lstsq(k.T @ k + 1e-4 * len(sample) * m + 1e-8 * np.eye(len(m)), k.T @ y, rcond=None)[0]
    assert np.allclose(k @ model.weights, k @ want, atol=1e-4)
    names, score, _ = model.predict([t for _, t in sample], language.Grams())
    assert sum(a == b for a, (b, _) in zip(names, sample)) >= 28 and all(0 <= s <= 1 for s in score)


def test_language_stage_rejects_other_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = ["a 1234 5678 #### $$ 000", "Это предложение написано на русском языке, и ему здесь не место.", "今日はとても良い天気ですね。散歩に行きましょう。", "qzxv wkjq zzxq pqow xkcd vbnm"]
    own = docs.limit(0).unionByName(docs.select(F.explode(F.array(*map(F.lit, junk))).alias("text")).distinct(), allowMissingColumns=True)
    every = docs.unionByName(own.withColumn("doc_id", F.lit(-1).cast(docs.schema["doc_id"].dataType)))
    got = corpus_pipeline.language_stage(spark, every, SF)
    assert got.filter("doc_id = -1").count() == 0
    assert got.count() >= 0.98 * docs.count()


def test_kernel_equals_plain(docs):
    texts = [r.text for r in docs.limit(12).collect()]
    model = language.fit([("x", t) for t in texts[:6]] + [("y", t) for t in texts[6:]])
    got = model.kernel(texts, language.Grams())
    sets = [[{b[i : i + n] for i in range(len(b) - n + 1)} for n in (1, 2, 3)] for b in (t.lower().encode() for t in texts)]
    want = [[np.mean([len(a[n] & b[n]) / np.sqrt(len(a[n]) * len(b[n])) for n in range(3)]) for b in sets] for a in sets]
    assert np.allclose(got, want, atol=1e-5)


def plain_segments(at, gain, cost):
    """Maximal segments by definition: recursively the best one, then left and right of it."""
    n = at[-1] + 1 if at else 0
    s = [-cost] * n
    for p, g in zip(at, gain):
        s[p] = g

    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += s[j]
                if total > 0 and (top is None or total > top[2] + 1e-9):
                    top = (i, j, total)
        return [] if top is None else [*best(a, top[0]), top, *best(top[1] + 1, b)]

    return best(0, n)


def test_segments_equal_plain():
    r = random.Random(5)
    for _ in range(200):
        at = sorted(r.sample(range(40), r.randint(0, 12)))
        gain = [r.uniform(0.5, 3.5) for _ in at]  # equal scores would leave a choice
        got, want = toxicity.segments(at, gain, 0.7), plain_segments(at, gain, 0.7)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in want]


def test_segments_take_linear_time():
    def took(n):
        began = time.process_time()
        toxicity.segments([100 * k for k in range(n)], [1.0] * n, 0.05)
        toxicity.segments(list(range(0, 3 * n, 3)), [1.0] * n, 0.45)
        return time.process_time() - began

    took(1000)
    assert took(160_000) < 60 * took(10_000) + 0.05


def test_extreme_value_scale():
    rng = np.random.default_rng(4)
    n = rng.integers(50, 500, 4000)
    k, decay = 0.03, 0.8
    best = np.log(k * n / rng.exponential(1.0, 4000)) / decay  # exactly this law
    got = toxicity.solve_scale([(int(a), max(0.0, float(b))) for a, b in zip(n, best)], decay)
    assert abs(got / k - 1) < 0.1
    model = toxicity.Model({"bad": 3.0}, decay=0.8, scale=0.03, curve=(-4.0, 0.1, 0.1))
    scores = [model.score("fine " * 20 + "bad " * k) for k in range(1, 40)]
    assert scores == sorted(scores) and len(set(scores)) == len(scores)


def test_toxicity(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = toxicity.rate(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    clean, bad = [r for r in held if r.toxic == 0], [r for r in held if r.toxic == 1]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean) and sum(r.predicted for r in bad) >= 0.6 * len(bad)
    edge = toxicity.rate(odd, model, ident="text").select("text", F.col("score").alias("s"), "predicted").collect()
    assert len(edge) == 10 and all(0 <= r.s <= 1 for r in edge)
    assert toxicity.rate(none, toxicity.train(none, labels)).count() == 0


# --- 6


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(r, words, share):
    return [w if r.random() > share else r.choice(["x", "y", "z"]) + w for w in words]


def test_jaccard_equals_plain(spark):
    r = random.Random(4)
    vocab = [f"v{i}" for i in range(400)]
    passage = " ".join(r.choices(vocab, k=60))
    rows = []
    for g in range(12):  # groups of near copies of many sizes, some at the border of 0.8
        base = r.choices(vocab, k=r.choice([6, 20, 60, 200]))
        rows += [" ".join(edited(r, base, r.choice([0, 0.01, 0.02, 0.04]))) for _ in range(r.choice([1, 2, 5, 30]))]
    rows += [passage + " " + " ".join(r.choices(vocab, k=r.choice([2, 10, 30, 90]))) for _ in range(40)]  # one passage in many
    rows += ["a b c", "A b C", "a b", "", None, "one two three four five"]
    rows = list(enumerate(rows))
    got = jaccard.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == plain_components(rows)


def test_jaccard_edges(spark, odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(odd).collect()), key=str)
    assert got == sorted(
        [(1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (None, 6, None), (4, 0, 4), (5, 997, 5), (6, 997, 5), (7, 1, 7), (8, 2, 1)], key=str
    )
    assert jaccard.components(none).count() == 0


def test_used_hashes_suffice():
    r = random.Random(6)
    for _ in range(500):
        n = r.randint(1, 120)
        x = set(r.sample(range(10**6), n))
        y = set(list(x)[r.randint(0, n // 5) :]) | set(r.sample(range(10**6), r.randint(0, n // 5)))
        both = len(x & y)
        if y and 100 * both >= 80 * (len(x) + len(y) - both):
            shared = set(sorted(x)[: jaccard.lowest(len(x))]) & set(sorted(y)[: jaccard.lowest(len(y))])
            assert len(shared) >= 1 + min(len(x) // 10, len(y) // 10)


# --- 8


def test_bpe_equals_tiktoken(docs, odd, none):
    own = bpe.Coder(bpe.default_path())
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(1)
    texts = ["  a  b\n\n c ", "x" * 5000 + "ab" * 2000, "it's I'LL", "日本語 ١٢", "a \x85b"]
    texts += ["".join(r.choice("ab é\n\t'sl1.,　\x85\x1c日ſ") for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for t in texts:
        assert own.encode(t) == lib.encode_ordinary(t) and own.decode(own.encode(t)) == t.encode()
    for df in (docs, odd):
        want = Counter()
        for x in df.collect():
            ids = lib.encode_ordinary(x.text or "")
            want[(x.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(utf8(x.text)).hexdigest())] += 1
        assert Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.digest(df).collect()) == want
    assert bpe.digest(none).count() == 0 and bpe.encode(odd).count() == 10


def test_bpe_fold_in_sql_functions(spark):
    ranks = bpe.load_ranks(bpe.default_path())
    r = random.Random(2)
    words = ["the", "there", "a", "", " inner", "ation", "thththing", "\0\0", "éàü ñ", "aaaaaaa", "日本語", "x" * 70]
    words += ["".join(r.choice(["an", "ou", "é", " ", "th", "er", "zq", "1", "\n"]) for _ in range(r.randint(1, 9))) for _ in range(300)]
    df = spark.createDataFrame([(w.encode(),) for w in words], "word binary")
    got = bpe.fold_words(df, ranks).collect()
    assert {bytes(x.word) for x in got} == {w.encode() for w in words}
    for x in got:
        assert x.ids == (bpe.merge(bytes(x.word), ranks) if x.word else []) and x.decoded == x.word


# --- 10


MSG = "thread bigint, ord bigint, id string, text string"


def test_quotes(spark):
    rows = [
        (1, 0, "1:0", "How are you?\nFine day."), (1, 1, "1:1", "On Monday Ann wrote:\n> how are  you?\nGood."), (1, 2, "1:2", "> > How are you?\n> Good.\n\nMe too."),
        (1, 3, "1:3", "No quote."), (2, 5, "2:5", "> Me too.\nElsewhere."), (None, 9, "x", "> Elsewhere.\nLoose."), (None, 9, "y", None), (3, 0, "3:0", "> unknown"),
    ]
    got = {r.id: r for r in quoting.conversations(spark.createDataFrame(rows, MSG)).collect()}
    assert {k: r.parent for k, r in got.items()} == {"1:0": None, "1:1": "1:0", "1:2": "1:1", "1:3": "1:2", "2:5": "1:2", "x": "2:5", "y": None, "3:0": None}
    assert got["1:1"].body == "Good." and got["1:2"].body == "Me too." and got["y"].body == "" and got["3:0"].body == ""
    assert {got[k].conversation for k in ("1:0", "1:3", "2:5", "x")} == {"t1"} and got["3:0"].conversation == "t3" and got["y"].conversation == "my"
    assert (got["1:2"].n_quoted, got["1:2"].n_linked, got["3:0"].n_linked) == (2, 2, 0)
    assert quoting.conversations(spark.createDataFrame([], MSG)).count() == 0


def test_quotes_positions_of_conversations(spark):
    rows = [
        (None, 1, "a", "First words."), (None, 2, "b", "> First words.\nSecond words."), (None, 3000, "c", "> Second words.\nThird words."),
        (7, 10, "7:0", "> Second words.\nA thread."), (7, 11, "7:1", "Goes on."), (8, 12, "8:0", "> Goes on.\nAnother thread."), (None, 5, "z", "Alone."),
    ]
    got = {r.id: r for r in quoting.conversations(spark.createDataFrame(rows, MSG)).collect()}
    assert {k: r.position for k, r in got.items()} == {"a": 1, "b": 2, "7:0": 3, "7:1": 4, "8:0": 5, "c": 6, "z": 1}
    assert {got[k].conversation for k in ("a", "b", "c", "7:1", "8:0")} == {"ma"}
    assert all(r.parent is None or got[r.parent].position < r.position for r in got.values())


def test_quotes_hot_thread_and_line(spark):
    rows = [(1, i, f"1:{i}", f"> same line\nown {i}" if i else "same line") for i in range(3000)]
    rows += [(2 + i, 0, f"{2 + i}:0", "same line") for i in range(500)]
    got = quoting.conversations(spark.createDataFrame(rows, MSG))
    assert got.filter("thread = 1 and position <> ord + 1").count() == 0
    assert got.filter("thread = 1 and ord > 0 and parent <> '1:0'").count() == 0 and got.count() == 3500


def test_quotes_passages(spark):
    rows = [
        (None, 0, "a", "x\ny"), (None, 1, "b", "y\nz"), (None, 2, "c", "One line.\nTwo lines.\n\nNext paragraph."),
        # y lies in a and b: as a line it is a's; y and z together are b's whole.
        (None, 5, "d", "> y\nAnswer to a."), (None, 6, "e", "> y\n> z\nAnswer to b."), (None, 7, "f", "> one  line.\n> two lines.\n>\n> Next paragraph.\nTo c."),
        (None, 8, "g", "> Two lines.\n> unknown\nTo c, in part."), (None, 9, "h", "> > x\n> > y\n> Answer to b.\n\nTo e."),
    ]
    got = {r.id: r for r in quoting.conversations(spark.createDataFrame(rows, MSG)).collect()}
    assert {k: got[k].parent for k in "defgh"} == {"d": "a", "e": "b", "f": "c", "g": "c", "h": "e"}
    assert {k: (got[k].n_quoted, got[k].n_linked) for k in "defgh"} == {"d": (1, 1), "e": (2, 2), "f": (3, 3), "g": (2, 1), "h": (3, 3)}


CHAT = "conv_id bigint, turn int, role string, text string"


def test_chat_query_edges(spark):
    long = "\n".join(f"line {k} of a long text" for k in range(20_000))
    rows = [
        (None, 3, "user", "alpha beta"), (None, 4, "user", "> alpha beta"), (None, 4, "bot", "> alpha beta"), (None, None, None, None), (-5, 0, "user", ""),
        (-5, 1, "bot", "> nothing known"), (7, 0, "user", "same"), (7, 0, "user", "same"), (7, 1, "bot", "> same\nYes."), (7, 1, "bot", "> same\nYes."),
        (8, 0, "user", long), (8, 1, "bot", "\n".join("> " + x for x in long.split("\n")) + "\nRead."),
    ]
    df = spark.createDataFrame(rows, CHAT).withColumns({"a.b": F.lit(1), "id": F.lit("x"), "body": F.lit("y"), "thread": F.lit(2)})
    got = queries._conversations(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[(r.conv_id, r.turn, r.role)].append(r)
    assert len(by[(7, 1, "bot")]) == 2 and all((r.n_quoted, r.n_linked, r.parent_turn, r.body, r.position) == (1, 1, 0, "Yes.", 2) for r in by[(7, 1, "bot")])
    assert [(r.parent_conv_id, r.parent_turn, r.n_linked, r.conversation_id) for r in by[(None, 4, "user")] + by[(None, 4, "bot")]] == [(None, 3, 1, None)] * 2
    assert by[(-5, 1, "bot")][0].conversation_id == -5 and by[(-5, 1, "bot")][0].parent_turn == 0
    assert by[(None, None, None)][0].body == "" and by[(8, 1, "bot")][0].body == "Read." and by[(8, 1, "bot")][0].n_linked == 20_000
    mails = queries._conversations(queries._as_mails(df)).collect()
    assert len(mails) == len(rows) and sum(r.body == long for r in mails) == 1
    assert queries._conversations(spark.createDataFrame([], CHAT)).count() == 0


def test_transcripts(spark):
    rows = [(1, k, f"1:{k}", f"> said {k - 1}\nsaid {k}" if k else "said 0") for k in range(10)]
    got = quoting.transcripts(quoting.conversations(spark.createDataFrame(rows, MSG)), rows=4).orderBy("part").collect()
    assert [(r.part, r.first, r.last) for r in got] == [(0, 1, 4), (1, 5, 8), (2, 9, 10)]
    assert "\n\n".join(r.text for r in got) == "\n\n".join(f"said {k}" for k in range(10))


def test_quotes_plan_is_native(spark):
    plan = quoting.conversations(spark.createDataFrame([(1, 0, "a", "x")], MSG))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- queries and pipeline


def test_html_parts_of_an_article():
    for part, want in (
        ('<div class="overflow-hidden"><p>Body text.</p></div>', "Body text."), ('<p aria-hidden="false">Body text.</p>', "Body text."), ('<p data-note="no hidden cost">Body text.</p>', "Body text."),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>", "Let x=2 be."), ("<p>See <svg><text>Figure 1</text></svg> here.</p>", "See Figure 1 here."),
    ):
        assert html.extract(f"<html><body><nav>Menu</nav><article>{part}</article></body></html>") == want


def test_surge_and_dive_choose_without_telling_names():
    story = ["A first paragraph of the story, long enough to count as text for any reader." for _ in range(6)]
    menu = "".join(f'<div><a href="/{k}">Link {k}</a></div>' for k in range(12))
    page = f"<html><body><div>{menu}</div><div>" + "".join(f"<div>{x}</div>" for x in story) + f"</div><div>{menu}</div></body></html>"
    assert html.extract(page) == "\n".join(story)
    weights = [0, 0, 5, 80, 70, 0, 3, 90, 0, 0, 0, 2, 0]
    plain = []
    for i in range(len(weights)):
        inside = any(a <= i < b for a, b in plain)
        if not inside and weights[i] and sum(weights[i : i + 3]) >= 60:
            j = i
            while j < len(weights) and sum(weights[j : j + 3]) > 0:
                j += 1
            plain.append((i, j))
    assert html.stretches(weights) == plain


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_covers_its_table(spark, name):
    table = {"op4_html_text": "pages", "op10_chat_quotes": "conversations", "chat_turns": "conversations", "chat_transcripts": "conversations"}.get(name, "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    got = queries.QUERIES[name](spark, SF)
    assert got.count() >= (rows.count() if name != "chat_transcripts" else rows.select("conv_id").distinct().count())


def test_pipeline(spark, odd):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == source.columns and out.exceptAll(docs).count() == 0, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    left = plain_components([(r.doc_id, r.text) for r in docs.collect()])
    assert all(i == c for i, (_, c) in left.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    kept = corpus_pipeline.near_duplicate_stage(spark, odd, SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, None, 4, 5, 7])) and kept.columns == odd.columns


def test_language_tables_are_small_and_start_anew():
    """Tables of a byte for each n-gram, and the same counts and marks after more texts than a byte counts."""
    grams = language.Grams()
    assert sum(t.nbytes for t in grams.seen) < 20_000_000
    for k in range(600):
        text = f"Über {k} größte {k % 7} aaaa"[: k % 23]
        a = text.lower().encode()
        want = [{a[i : i + n] for i in range(len(a) - n + 1)} for n in language.LENGTHS]
        mark, count = grams.stamp(text)
        assert count == [len(s) for s in want]
        for table, s in zip(grams.seen, want):
            assert set(np.flatnonzero(table == mark).tolist()) == {int.from_bytes(g, "big") for g in s}


def test_memory_of_other_operators_goes_back_before_the_work(spark, monkeypatch):
    from tidemark.llm import common

    seen = []
    monkeypatch.setattr(common, "FORGET", {"words": lambda: seen.append("forgotten")})
    monkeypatch.setattr(common, "release", lambda: seen.append("released"))
    list(common.lean(lambda batches: (seen.append("work") for _ in range(1)))(iter([])))
    assert seen == ["forgotten", "released", "work", "released"]


def test_workers_drop_their_own_caches(monkeypatch):
    """Work that was sent to a worker drops what that worker holds, not a copy of what the driver held."""
    from pyspark import cloudpickle
    from tidemark.llm import common

    monkeypatch.setattr(common, "FORGET", {})
    sent = cloudpickle.dumps(common.lean(lambda batches: batches))
    seen = []
    common.FORGET["words"] = lambda: seen.append("forgotten")
    list(cloudpickle.loads(sent)(iter([])))
    assert seen == ["forgotten"] and not common.FORGET


def test_postings_and_regions_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, 2000)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])
    tracemalloc.start()
    packed = list(jaccard._postings(1)(iter([batch])))
    of_postings = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    rows = sum(b.num_rows for b in jaccard._regions(iter(packed)))
    of_regions = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert of_postings < 50_000_000 and of_regions < 60_000_000 and rows == 0


def test_regions_in_parts_equal_whole(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 3000, 40) * 2**48 + 7) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])
    by_hash = defaultdict(list)
    for node, s in enumerate(sets):
        for h in s:
            by_hash[int(h) >> 16].append(node)
    size = list(map(len, sets))
    want = Counter()
    for h, nodes in by_hash.items():
        if len(nodes) > jaccard.SMALL:
            want.update((1, a, h, size[a], size[a]) for a in nodes)
        else:
            want.update((0, a, b, size[a], size[b]) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if 5 * min(size[a], size[b]) >= 4 * max(size[a], size[b]))
    for part in (10**9, 500):
        monkeypatch.setattr(jaccard, "PART_HASHES", part)
        packed = list(jaccard._postings(3)(iter([batch])))
        got = Counter()
        for kind, run in ((0, jaccard._regions), (-1, jaccard._members)):
            for p in packed:
                own = [i for i, b in enumerate(p.column(0).to_pylist()) if (b < 0) == (kind < 0)]
                for r in run(iter([p.take(pa.array(own, pa.int64()))])):
                    got.update(zip(*[c.to_pylist() for c in r.columns]))
        assert got == want
