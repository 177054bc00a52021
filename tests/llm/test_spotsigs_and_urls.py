import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.llm import queries, spotsigs, url_filter
from docsift.llm.common import stored
from docsift.llm.spotsigs import SpotSigs, compared_with_edits, edited_text, fingerprints, jaccard, near_pairs


def brute_set(text, anchors=frozenset(spotsigs.ANCHORS)):
    """Chains as tuples of words."""
    words = [w for w in (p.decode().lower().encode().strip(spotsigs._STRIP).decode(errors="replace") for p in (text or "").encode().split()) if w]
    content = [(n, w) for n, w in enumerate(words) if w not in anchors]
    chains = set()
    for n, word in enumerate(words):
        if word in anchors:
            behind = [w for at, w in content if at > n][: spotsigs.CHAIN]
            if len(behind) == spotsigs.CHAIN:
                chains.add((word, *behind))
    return chains or ({tuple(words)} if words else set())


def brute_jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(rng, n):
    words = ["the", "of", "und", "la", "house", "Tree,", "sky", "é.", "river", "...", "THE", "stone"]
    return [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(n)]


def test_sets_match_brute_force():
    rng = random.Random(1)
    all_texts = [None, "", "...", "the", "house", "the house", "the house sky", "house the"] + texts(rng, 200)
    found, bounds = SpotSigs().sets(all_texts)
    sets = [found[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    brute = [brute_set(t) for t in all_texts]
    assert [len(s) for s in sets] == [len(b) for b in brute]
    for _ in range(500):
        a, b = rng.randrange(len(sets)), rng.randrange(len(sets))
        assert jaccard(sets[a], sets[b]) == pytest.approx(brute_jaccard(brute[a], brute[b]))
        full = jaccard(sets[a], sets[b])
        assert jaccard(sets[a], sets[b], 0.8) == full if full >= 0.8 else True


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_edits_and_next_documents(spark, partitions):
    rng = random.Random(2)
    rows = [(rng.randrange(-50, 10_000), t) for t in texts(rng, 120)] + [(None, "the first house"), (5, "the b c"), (5, "the a c"), (20_000, None)]
    rows.append((7, "the very long house " * 300))
    df = spark.createDataFrame(rows, "doc long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = compared_with_edits(df, "doc", "text").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for n, (doc, text) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        edit = edited_text(text, following)
        own = brute_set(text)
        want.append((str(doc), len(text), hashlib.sha256(edit.encode()).hexdigest(), round(brute_jaccard(own, brute_set(edit)), 9), round(brute_jaccard(own, brute_set(following)), 9)))
    assert sorted((str(r.doc), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)


def test_edited_text():
    assert edited_text("abcdefgh", "XYZ") == "abcdefXY"
    assert edited_text("abcdefgh", "X") == "abcdefX"
    assert edited_text("abc", "X") == "abc"


def test_equal_texts_near_pairs_and_empty(spark):
    rng = random.Random(3)
    base = texts(rng, 60)
    rows = list(enumerate(base + base[:5] + [" ".join(t.split()[:-1]) for t in base] + [None, ""]))
    df = spark.createDataFrame(rows, "doc long, text string")
    prints = fingerprints(df, "doc", "text")
    by_doc = {r.doc: r.fingerprint for r in prints.collect()}
    assert all(by_doc[n] == by_doc[60 + n] for n in range(5)) and by_doc[rows[-1][0]] == by_doc[rows[-2][0]] == ""
    sets = {f: set(f[i : i + 8] for i in range(0, len(f), 8)) for f in by_doc.values() if f}
    for at_least in (0.5, 0.8):
        want = {(a, b) for a in sets for b in sets if a < b and brute_jaccard(sets[a], sets[b]) >= at_least}
        assert {(r.a, r.b) for r in near_pairs(prints, at_least).collect()} == want
    assert compared_with_edits(df.limit(0), "doc", "text").count() == 0
    one = compared_with_edits(df.limit(1), "doc", "text").collect()[0]
    assert one.near_next == 1.0


URLS = [
    None, "", "no scheme/x", "http://A.EXAMPLE.NET/en/x?q#f", "https://example.net", "http://example.net/en", "http://x.example.com/de/1",
    "http://xexample.com/de/1", "ftp://b.org/fr/", "http://org/fr/x", "http://b.org/FR/", "http://É.ORG?x/y", "://h/p", "a://b://c/d", "http://net/",
    "http://cheap-pills.example.com/en/1", "http://cheappills.example.org/a", "http://\nx/\ny",
]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def brute_rule(host, path):
    best = None
    for verdict, rule in url_filter.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


def brute_tokens(url, segmenter):
    host, path = split_url(url)
    labels = host.split(".")
    kinds = [("h", label) for label in labels[:-1] or labels] + ([("t", labels[-1])] if len(labels) > 1 else []) + [("p", path)]
    names = [(kind, name) for kind, part in kinds for name in re.findall(r"[^\W\d_]+|\d+", part.lower())]
    return [kind + word for kind, name in names for word in (["0"] if name[0].isdigit() else segmenter.split(name))]


def brute_odds(urls, segmenter, bits):
    """Odds of every URL by naive Bayes on hashed words, fitted on all hosts."""
    hashed = lambda tokens: [zlib.crc32(t.encode()) % 2**bits for t in tokens]
    split, hosts, spam = [brute_tokens(url, segmenter) for url in urls], {}, set()
    for url, tokens in zip(urls, split, strict=True):
        host = split_url(url)[0]
        if host:
            hosts.setdefault(host, set()).update(hashed(tokens))
            spam |= {host} if any(t[0] != "p" and t[1:] in url_filter.BLOCK_WORDS for t in tokens) else set()
    counts = [Counter(w for host, words in hosts.items() if (host in spam) == kind for w in words) for kind in (True, False)]
    totals = [c.total() + url_filter.SMOOTHING for c in counts]
    counts[0].update(set(hashed(k + w for k in "ht" for w in url_filter.BLOCK_WORDS)))
    both = counts[0] + counts[1]
    share = lambda kind, t: (counts[kind][t] + url_filter.SMOOTHING * both[t] / both.total()) / totals[kind]
    prior = math.log((len(spam) + 1) / (len(hosts) - len(spam) + 1))
    return [prior + sum(math.log(share(0, t) / share(1, t)) for t in hashed(tokens) if t in both) for tokens in split]


def words_table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def fitted(df, lexicon, id_column="page"):
    split = stored(url_filter.split_urls(df, id_column, "url", lexicon), "split")
    return split, url_filter.fit_split(split)


def test_urls(spark):
    rows = [(n, u, 1) for n, u in enumerate(URLS)] + [(None, URLS[3], 1), (None, URLS[3], 1)]
    df = spark.createDataFrame(rows, "page long, url string, host int")
    counts = {"cheap": 50, "pills": 40, "example": 30, "che": 5}
    got = url_filter.judged_split(*fitted(df, words_table(spark, counts))).collect()
    assert len(got) == len(URLS) + 2
    odds = brute_odds([u for _, u, _ in rows], url_filter.Segmenter(counts), url_filter.BITS)
    for r in got:
        n = 3 if r.page is None else r.page
        host, path = split_url(URLS[n])
        rule = brute_rule(host, path)
        assert (r.host, r.path) == (host, path)
        assert r.rule == (rule[1] if rule else None)
        assert r.verdict == (rule[0] if rule else "block" if r.odds > 0 else "allow")
        assert np.isclose(r.odds, odds[n])
    assert {r.page: r.verdict for r in got}[16] == "block" and {r.page: r.host_words for r in got}[16] == "cheap pills example org"
    empty = df.limit(0)
    assert url_filter.judged_split(*fitted(empty, words_table(spark, counts))).count() == 0


def test_block_words_in_any_label(spark):
    urls = ["http://win.casino/x", "http://cheappills/x", "http://a.b.casino:80/", "http://casino.example.org", "http://good.example.org/casino"]
    counts = {"cheap": 5, "pills": 5, "casino": 9, "win": 9}
    df = spark.createDataFrame(list(enumerate(urls)), "page long, url string")
    tokens = {r.page: r.tokens for r in url_filter.split_urls(df, "page", "url", words_table(spark, counts)).collect()}
    assert tokens[0] == ["hwin", "tcasino", "px"] and tokens[1] == ["hcheap", "hpills", "px"] and tokens[2] == ["ha", "hb", "tcasino", "t0"]
    many = spark.createDataFrame([(n, u) for n, u in enumerate(urls * 3 + ["http://good.example.org/" + c for c in "abcdefghijkl"] + [f"http://casino.x{n}.net" for n in range(4)])], "page long, url string")
    got = {r.page: r.verdict for r in url_filter.judged_split(*fitted(many, words_table(spark, counts))).collect()}
    assert [got[n] for n in range(5)] == ["block"] * 4 + ["allow"]


def test_a_very_long_name_is_split_like_others(spark):
    counts = {"spam": 9, "house": 30, "abcdefghijklmnopqrst": 2}
    names = ["spamhouse" * 12_000, "house" * 900 + "abcdefghijklmnopqrst" * 300, "q" * 30_000]
    df = spark.createDataFrame([(n, f"http://{name}.org/{name}") for n, name in enumerate(names)], "page long, url string")
    tokens = {r.page: r.tokens for r in url_filter.split_urls(df, "page", "url", words_table(spark, counts)).collect()}
    segmenter = url_filter.Segmenter(counts)
    assert all(tokens[n] == brute_tokens(f"http://{name}.org/{name}", segmenter) for n, name in enumerate(names))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_hosts_that_the_fit_has_not_seen(spark, folder):
    """Whole hosts are held out: at least 0.9 of those with a block word are blocked, and under 1 % of the others."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    words = url_filter.word_table(pages, "html", extra=tuple(url_filter.BLOCK_WORDS))
    split = stored(url_filter.split_urls(pages, "page_id", "url", words), "split")
    fold, judged = F.pmod(F.xxhash64("host"), F.lit(5)), []
    for n in range(5):
        model = url_filter.fit_split(split.where(fold != n))
        judged += url_filter.judged_split(split.where(fold == n), model, rules=()).collect()
    wanted = [set(r.host_words.split()) & set(url_filter.BLOCK_WORDS) != set() for r in judged]
    blocked = [r.verdict == "block" for r in judged]
    caught = sum(w and b for w, b in zip(wanted, blocked, strict=True))
    wrong = sum(b and not w for w, b in zip(wanted, blocked, strict=True))
    print(folder, "of", sum(wanted), "caught", caught, "of", len(wanted) - sum(wanted), "wrong", wrong)
    assert sum(wanted) > 0 and caught >= 0.9 * sum(wanted) and wrong < 0.01 * (len(wanted) - sum(wanted))


def test_registered_query_judges_by_its_odds(spark):
    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    counts = {r.word: r.n for r in url_filter.word_table(pages, "html", extra=tuple(url_filter.BLOCK_WORDS)).collect()}
    urls = {r.page_id: r.url for r in pages.collect()}
    odds = dict(zip(urls, brute_odds(list(urls.values()), url_filter.Segmenter(counts), url_filter.BITS), strict=True))
    got = queries.op10_url_filter(spark, folder).collect()
    assert {r.page_id for r in got} == urls.keys() and len(got) == len(urls)
    for r in got:
        rule = brute_rule(*split_url(urls[r.page_id]))
        assert np.isclose(r.odds, odds[r.page_id])
        assert r.verdict == (rule[0] if rule else "block" if r.odds > 0 else "allow")
    assert any(r.verdict == "block" and r.rule is None for r in got)


def test_segmentation_is_the_most_probable_one():
    rng = random.Random(4)
    counts = {"".join(rng.choices("ab", k=rng.randint(1, 4))): rng.randint(1, 99) for _ in range(12)}
    segmenter = url_filter.Segmenter(counts)

    def cost(words):
        return sum(segmenter.cost.get(w, segmenter.unknown + 2.3 * len(w)) for w in words)

    def splits(name):
        if not name:
            yield []
        for end in range(1, len(name) + 1):
            for rest in splits(name[end:]):
                yield [name[:end], *rest]

    for _ in range(60):
        name = "".join(rng.choices("abc", k=rng.randint(1, 9)))
        words = segmenter.split(name)
        assert "".join(words) == name and np.isclose(cost(words), min(map(cost, splits(name))))


def test_lexicon_counts_all_rows(spark):
    df = spark.createDataFrame([("<p class=\"zz\">Big house</p> big",), (None,), ("house, BIG é-é x",)], "html string")
    assert {r.word: r.n for r in url_filter.word_table(df, "html", extra=("spam", "big")).collect()} == {"big": 3, "house": 2, "spam": 2}


def test_every_word_splits_names_however_many_there_are(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(60_000)})
    rows = [(" ".join(words[n::20]) + (" tail" if n == 0 else ""),) for n in range(20)]
    texts = spark.createDataFrame(rows, "html string")
    table = url_filter.word_table(texts, "html", extra=("spam",))
    counts = {r.word: r.n for r in table.collect()}
    assert counts == dict.fromkeys(words, 1) | {"tail": 1, "spam": 2}
    urls = ["http://" + words[7] + words[-3] + "tail.ab.org/" + words[n * 31] + "spam/7/" + "abcdefgh" * n for n in range(40)] + [None, "http://x/y", "http://É.spamTAIL.com/" + "Z" * 50]
    df = spark.createDataFrame([(n % 9 or None, u) for n, u in enumerate(urls * 2)], "page long, url string")
    got = sorted(((r.page or -1, r.tokens) for r in url_filter.split_urls(df, "page", "url", table).collect()), key=repr)
    segmenter = url_filter.Segmenter(counts)
    assert got == sorted(((n % 9 or -1, brute_tokens(u, segmenter)) for n, u in enumerate(urls * 2)), key=repr)
    assert any("htail" in r[1] for r in got)
