import json
import random
import zlib
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from stampbook.llm import token_shards
from stampbook.llm.perspectives import rotated
from stampbook.llm.token_shards import Encoder, KeyIndex, Shard, read_documents, write_shards
from stampbook.llm.url_rules import PATTERNS, SITES, judge, rule_table
from support import documents, prose

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")


def split_url(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:cut], rest[cut:]


def verdict(url):
    import fnmatch

    host, path, rest = split_url(url)
    fits = [(len(r), r, v) for r, v in SITES if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
    if fits:
        _, r, v = max(fits)
        return host, path, r, v
    fits = [(len(p), v) for p, v in PATTERNS if url and "://" in url and fnmatch.fnmatchcase(f".{host}{path}{rest}", p)]
    return host, path, None, max(fits)[1] if fits else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://com/", "http://com", "HTTP://Example.COM/en/x", "https://www.example.com/en/", "https://www.example.com/en", "https://a.www.example.com/en/1?x#y",
    "https://myexample.com/en/1", "http://x.net/es/", "http://x.net/ES/", "http://net/fr/a/b", "http://x.net?/fr/", "http://x.net#a.com/", "http://x.org/login/now", "http://x.org/a?next=/login/",
    "http://x.casino.org", "http://casinos.org/casino", "http://x.com:80/", "http://u@y.com/a", "ftp://é.com/ü", "http://a.com/http://b.net/fr/", "http://a.b.example.com/en//", "://com/", "x://y.net/fr/\nz", "http://x.org/ads/\n?q",
]


def test_urls_against_plain_code(spark):
    r = random.Random(1)
    urls = URLS + ["".join(r.choice(["http://", "www.", "example.com", "net", ".", "/en/", "/es/", "/fr/", "/", "?", "#", "com", "login", "casino", "A"]) for _ in range(r.randint(1, 8))) for _ in range(300)]
    rows = [(i if i else None, u) for i, u in enumerate(urls)] + [(7, URLS[6])] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("html", "host", "token", "label", "rank", "best", "address")})
    got = judge(pages, rule_table(spark)).collect()
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(((i, *verdict(u)) for i, u in rows), key=str)
    assert {x.verdict for x in got} == {"allow", "block"}
    assert judge(pages.limit(0), rule_table(spark)).count() == 0
    assert {x.verdict for x in judge(pages, rule_table(spark, [], [])).collect()} == {"allow"}


def rendered(turns):
    """By plain code: {perspective: (text, mask, own turns)}"""
    name = lambda r: "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "_" for c in r or "") or "unnamed"
    turns = sorted(((t is None, t, name(r), (x or "").replace("<|", "< |")) for t, r, x in turns), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
    out = {}
    for who in {n for _, _, n, _ in turns if n != "system"}:
        text, mask = "", []
        for _, _, n, x in turns:
            text += "<|assistant|>\n" if n == who else "<|system|>\n" if n == "system" else f"<|user name={n}|>\n"
            a = len(text)
            text += x + "<|end|>"
            if n == who:
                mask.append(f"{a}-{len(text)}")
            text += "\n"
        out[who] = (text, ",".join(mask), len(mask))
    return out


def test_perspectives_against_plain_code(spark):
    r = random.Random(2)
    rows = [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", "system", "Ana B", "élan", None, ""]), r.choice([None, "", "hi <|end|> 😀", prose((c or 99) * 50 + t, 5)])) for c in [*range(12), None] for t in range(r.randint(1, 9))]
    rows += [(100, 0, "system", "alone")] + [(101, 1, "user", "twice")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("name", "at", "part", "own", "p", "n")})
    got = {(x.conv_id, x.perspective): (x.rendered, x["mask"], x.own_turns) for x in rotated(df).collect()}
    want = {}
    for c in {x[0] for x in rows}:
        want |= {(c, who): v for who, v in rendered([x[1:] for x in rows if x[0] == c]).items()}
    assert got == want
    assert rotated(df.limit(0)).count() == 0


def test_roles_of_one_cleaned_name_stay_apart(spark):
    roles = ["Анна", "Иван", "Anna B", "Anna_B", "a+b", "a b", "a_b", "a%20b", "system", "unnamed", None, "", "Ana B"]
    rows = [(1, t, role, f"says {t}") for t, role in enumerate(roles)] + [(2, 0, "Иван", "alone"), (2, 1, "Anna B", "x"), (None, 0, "Анна", "y"), (None, 0, "Иван", "y")]
    got = rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {x.perspective: x for x in got if x.conv_id == 1}
    assert len(by) == sum(x.conv_id == 1 for x in got) == 11  # system has none, missing and empty are one
    for name, x in by.items():
        of = {"%": (None, ""), "Ana_B": ("Ana B",), "a_20b": ("a%20b",)}.get(name, (unquote(name),))
        want = [f"says {t}<|end|>" for t, role in enumerate(roles) if role in of]
        assert want and [x.rendered[int(i) : int(j)] for i, j in (s.split("-") for s in x["mask"].split(","))] == want, name
        assert x.own_turns == x.rendered.count("<|assistant|>") == len(want)
        assert all(f"<|user name={k}|>" in x.rendered for k in by if k != name)
    assert {"Anna_B", "Anna%20B", "a_b", "unnamed", "%", "Ana_B"} < set(by)
    assert {x.perspective for x in got if x.conv_id == 2} == {"____", "Anna_B"}
    assert len({x.perspective for x in got if x.conv_id is None}) == 2


def test_long_dialogue_in_parts(spark):
    rows = [(1, t, "ab"[t % 2], f"t{t}") for t in range(25)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = sorted(rotated(df, part_turns=10).where("perspective = 'a'").collect(), key=lambda x: x.part)
    assert [x.n_turns for x in parts] == [10, 10, 5]
    assert "".join(x.rendered for x in parts) == rendered([x[1:] for x in rows])["a"][0]
    for x in parts:
        spans = [tuple(map(int, s.split("-"))) for s in x["mask"].split(",")]
        assert all(x.rendered[a:b].startswith("t") and x.rendered[a:b].endswith("<|end|>") for a, b in spans)
        assert x.masked_chars == sum(b - a for a, b in spans)


@pytest.fixture(scope="module")
def path():
    return vocabularies.path("byte_bpe_50k.json")


def test_encoder_gives_the_tokenizers_ids(path):
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    r = random.Random(3)
    parts = [*" \n\t\r  ab's'llé1.2,!中  \x85\x1c\x0b😀ßǅ", "<|endoftext|>", " the", "don't", "...", "Word!", " x?", "ok.", ";"]
    texts = ["", *("".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(4000))]
    encoder = Encoder(path, 2)
    for turn in range(2):  # the second time from the cache
        at = 0
        ids, n = encoder.encode(texts)
        for k, e in zip(n, t.encode_batch(texts, add_special_tokens=False)):
            assert ids[at : at + k].tolist() == [*e.ids, 2]
            at += k
        assert at == len(ids)
    assert encoder.encode([])[0].tolist() == []


def test_shards_hold_the_plain_librarys_ids_of_added_tokens(spark, path, tmp_path):
    t = tokenizers.Tokenizer.from_file(path)
    r = random.Random(9)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|endof", " a", "b ", "\n", "  ", ".", "Word,"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "plain", "", *("".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(300))]
    want = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert want[0] == [64, 220, 50256, 275, 2]
    ids, n = Encoder(path, 2, added=True).encode(texts)
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    folder = f"file://{tmp_path}/shards"
    manifest = write_shards(documents(spark, list(enumerate(texts))), folder, path, shards=3)
    got = sorted(read_documents(manifest, folder).collect(), key=lambda x: x.doc_id)
    assert [(x.n_tokens, x.ids_crc32) for x in got] == [(len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for x in want]


def test_key_index():
    for n in (0, 1, 2, 5000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        index = KeyIndex.build(keys, np.arange(len(keys), dtype=np.uint32))
        assert index.find(keys).tolist() == list(range(len(keys)))
        assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))  # minimal and perfect
        assert (index.find(keys + np.uint64(1 << 63)) == -1).mean() > 0.99 if n > 100 else True


def test_shards_round_trip(spark, path, tmp_path):
    rows = [(i * 3, prose(i, 1 + i % 50)) for i in range(200)] + [(7, "same"), (7, "same"), (7, "other"), (None, "none"), (8, None), (10, ""), (11, prose(1, 20000)), (-5, "minus")]
    folder = f"file://{tmp_path}/shards"
    manifest = write_shards(documents(spark, rows), folder, path, shards=4)
    got = read_documents(manifest, folder).collect()
    t = tokenizers.Tokenizer.from_file(path)
    start, want = 0, []
    for doc, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        n = len(t.encode(text or "", add_special_tokens=False).ids) + 1
        want.append((doc, n, zlib.crc32(np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())))
        start += n
    key = lambda x: (x[0] is None, x[0] or 0)
    ordered = sorted(got, key=lambda x: x.start)
    assert [x.doc_id for x in ordered] == [x[0] for x in sorted(want, key=key)]
    assert sorted(((x.doc_id, x.n_tokens, x.ids_crc32) for x in got), key=str) == sorted(want, key=str)
    assert [x.start for x in ordered] == [0, *np.cumsum([x.n_tokens for x in ordered])[:-1].tolist()]
    names = [x.name for x in manifest.collect()]
    shards = [Shard(folder, x) for x in names]
    find = lambda k: [x for x in (s.get(k) for s in shards) if x is not None]
    assert find(11)[0].tolist() == [*t.encode(prose(1, 20000), add_special_tokens=False).ids, 2]
    assert find(10)[0].tolist() == [2] and find(10**15) == [] and find(-5)
    raw = (tmp_path / "shards" / f"{names[0]}.idx").read_bytes()
    assert raw[:8] == token_shards.MAGIC and json.loads(raw[12 : 12 + int.from_bytes(raw[8:12], "little")])["width"] == 2
    assert (tmp_path / "shards" / f"{names[0]}.ids").stat().st_size == 2 * int(shards[0].ends[-1])


def test_no_documents(spark, path, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert read_documents(write_shards(documents(spark, []), folder, path), folder).count() == 0
