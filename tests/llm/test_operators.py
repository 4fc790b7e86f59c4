"""Each training-data operator against a brute-force version, on a fixture with every edge case, and on empty tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinderflow.llm import class_lm, decontamination, jaccard_join, license_scans, mixing, quality_classifier, quality_rules, token_ids, url_filters, warc
from cinderflow.storage import ship_package

SPACE = r"[^\x20\x09-\x0D]+"
LOWER = {i: i + 32 for i in range(65, 91)}
CLASH = ["row", "n", "cls", "shard", "hits", "rule", "prefix", "host", "words", "bucket", "score", "g", "size", "token"]


def words(t):
    return re.findall(SPACE, (t or "").translate(LOWER))


def texts():
    draw = random.Random(3)
    vocabulary = [draw.choice("abcdefgh") + draw.choice(["one", "two", "ré", "ß", "x."]) + str(k % 9) * (k % 2) for k in range(400)]
    base = [draw.choice(vocabulary) for _ in range(120)]
    out = []
    for _ in range(120):  # near copies
        w = list(base)
        for _ in range(draw.choice([1, 2, 3, 4])):
            w[draw.randrange(120)] = draw.choice(vocabulary)
        out.append(" ".join(w))
    out += [" ".join(draw.choice(vocabulary) for _ in range(draw.randrange(1, 90))) for _ in range(120)]
    out += [" ".join(base)] * 5 + [" ".join(base[:60] + [draw.choice(vocabulary) for _ in range(9)]) for _ in range(30)]
    out += [None, "", "  \n\t", "a", "A", "a b c", "A  b\tc", "a b c d", "x" * 50_000, "word " * 3000, "a\nb\nb\n\nb \n", "### $$$ %%% " * 30, "Released under the MIT License. CC BY-NC 4.0", "mit license mit license", "cc by cc by cc-by", "One two three four five six seven eight and then ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT", "Aa bb cc dd ee ff gg hh " * 2 + "aA bb cc dd ee ff gg hh"]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    ship_package(spark)
    rows = [(k, t, ["en", "de", None][k % 3], f"s{k % 4}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts())]
    rows += [(None, "a b c", None, None, 5), (None, None, "en", "s1", 0), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(5).cache()


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def same(a, b):
    assert collections.Counter(a) == collections.Counter(b)


def test_url_filters(spark):
    urls = ["http://A.example.net/en/1?x", "https://example.com/de/", "http://example.com.org/fr/x#y", "no scheme", None, "", "x://net", "http://net/", "http://a.b.NET/?/en/", "http://evilexample.com/de/", "ftp://Example.COM/de/a://b", "http://" + "a." * 3000 + "org/fr/"]
    pages = spark.createDataFrame([*enumerate(urls), (None, urls[0]), (0, urls[0])], "page_id long, url string").withColumns({c: F.lit("clash") for c in CLASH + ["path", "verdict"]})
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")

    def brute(url):
        host, path = "", ""
        if m := re.search(r"://([^/?#]*)([^?#]*)", url or ""):
            host, path = m[1].translate(LOWER), m[2]
        fit = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    want = [(r["page_id"], *brute(r["url"])) for r in pages.collect()]
    same(map(tuple, url_filters.judge(pages, rules).collect()), want)
    same(map(tuple, url_filters.judge(pages, rules, broadcast_rules=0).collect()), want)
    assert url_filters.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filters.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_jaccard_join(spark, docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.join(docs).collect()]
    rows = rows_of(docs)
    sets, links = [], collections.Counter()
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                    links.update((a, b))
                    root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    same(got, [(i, len(sets[k]), least.get(find(k)) if sets[k] else i, links[k]) for k, (i, _) in enumerate(rows)])
    assert jaccard_join.join(docs.limit(0)).count() == 0
    stay = jaccard_join.kept(docs)
    assert stay.columns == docs.columns
    assert {r["doc_id"] for r in stay.select("doc_id").collect()} == {i for i, _, c, _ in got if i is None or i == c}


@pytest.mark.parametrize("block", [4, 1024])
def test_jaccard_join_in_blocks(spark, monkeypatch, block):
    """Chains that drift from their leader, more members than a block holds: components equal brute force."""
    ship_package(spark)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    draw, rows = random.Random(11), []
    for family in range(12):
        w = [f"f{family % 3}w{draw.randrange(900)}" for _ in range(draw.choice([60, 150]))]
        for _ in range(draw.choice([3, 25, 40])):
            w = list(w)
            for _ in range(draw.choice([1, 1, 2, 3])):
                w[draw.randrange(len(w))] = f"v{draw.randrange(50)}"
            rows.append((len(rows), " ".join(w)))
    draw.shuffle(rows)
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if b < a and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(set(label.values())) < len(rows) // 2
    degree = collections.Counter(x for pair in links for x in pair)
    same([(r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard_join.join(docs).collect()], [(i, c, degree[i]) for i, c in label.items()])
    same([(r["doc_id"], r["component_id"]) for r in jaccard_join.join(docs, counted=False).collect()], label.items())


def test_components(spark):
    from cinderflow.llm.components import components

    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, 5000 + k) for k in range(1, 60)] + [(7, 7), (1, 2), (1, 2), (None, 3), (4, None)]
    label = {x: x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    while any(label[a] != label[b] for a, b in links if a in label and b in label):
        for a, b in links:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    same(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()), label.items())
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    size = {i: len(words(t)) for i, t in rows_of(docs)}
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(words(t))) for i, t in rows_of(docs))
    totals = collections.Counter()
    for r in docs.select("source", "text").collect():
        totals[r["source"]] += len(words(r["text"]))
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight, left, open_ = {s: 1 + k % 3 for k, s in enumerate(names)}, float(sum(totals.values())), set(names)
    target = dict.fromkeys(names, 0.0)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * totals[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 3.0 * totals[s] for s in full}
        left -= sum(3.0 * totals[s] for s in full)
        open_ -= full
    taken = collections.Counter()
    for r in got:
        if r["doc_id"] is None:
            continue
        s = source[r["doc_id"]]
        assert r["source_size"] == totals[s] and math.isclose(r["target"], target[s], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK + 12, (s, taken[s], target[s])
    same(map(tuple, mixing.mix(docs).collect()), map(tuple, got))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    by = collections.Counter()
    for r in out.select("doc_id", "text").collect():
        by[r["doc_id"]] += len(words(r["text"]))
    want = collections.Counter()
    for r in got:
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in by.items() if v} == {k: v for k, v in want.items() if v}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_shards_are_drawn(spark, docs, tmp_path, monkeypatch):
    """Counts of a shard's sources are draws that add up to each source's slots, slots are taken shard by shard, and the plan of mix() has them."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 40)
    sources = spark.createDataFrame([(0, 64 * 1000, 64.0 * 900), (1, 64 * 50, 64.0 * 150), (2, 10, 30.0), (3, 0, 0.0), (4, 6400, 0.2)], "nr int, source_size long, target double")
    plan = mixing.planned(sources, shard_slots=70)
    shards = plan.first()["shards"]
    slots = {r["nr"]: r["slots"] for r in plan.collect()}
    assert slots == {0: 900, 1: 150, 2: 3} and shards == math.ceil(sum(slots.values()) / 70)
    counts = collections.defaultdict(dict)
    for r in mixing.shard_counts(plan).collect():
        counts[r["nr"]][r["shard"]] = (r["count"], r["first"])
    for nr, by in counts.items():
        at = 0
        for shard in sorted(by):
            assert by[shard][1] == at and 0 <= shard < shards
            at += by[shard][0]
        assert at == slots[nr]
    mean = 900 / shards
    chi = sum((counts[0].get(k, (0, 0))[0] - mean) ** 2 / mean for k in range(shards))
    assert 2 < chi < 45 and len({c for c, _ in counts[0].values()}) > 3  # drawn, not dealt evenly
    got = mixing.drawn(sources, shard_slots=70).collect()
    assert collections.Counter((r["nr"], r["shard"]) for r in got) == {(nr, k): c for nr, by in counts.items() for k, (c, _) in by.items()}
    assert collections.Counter((r["nr"], r["turn"], r["block"]) for r in got if r["nr"] == 1) == {(1, t, b): 1 for t in range(3) for b in range(50)}
    some = mixing.mix(docs)
    assert "first" in some._jdf.queryExecution().optimizedPlan().toString()
    found = some.collect()
    assert max(r["shards"] for r in found) > 1 and all((r["shards"] > 0) == (r["taken"] > 0) for r in found)
    mixing.write(docs.select("doc_id", "text", "source"), f"file://{tmp_path}/mix")
    back = spark.read.parquet(f"file://{tmp_path}/mix")
    same([(r["doc_id"], r["text"]) for r in back.collect()], [(r["doc_id"], r["text"]) for r in mixing.mixed(docs).collect()])
    assert back.select("shard").distinct().count() > 1


def test_permutations_are_bijections(spark):
    sizes = [1, 2, 3, 5, 7, 16, 17, 100, 257, 1000]
    slots = spark.createDataFrame([(k, n, 99 + n) for n in sizes for k in range(n)], "k long, blocks long, key long")
    seen = collections.defaultdict(list)
    for r in mixing.permuted(slots).collect():
        seen[r["blocks"]].append(r["block"])
    assert {n: sorted(b) == list(range(n)) for n, b in seen.items()} == dict.fromkeys(sizes, True)


@pytest.mark.parametrize("pages_a_range", [5, 4096])
def test_warc(spark, monkeypatch, pages_a_range):
    monkeypatch.setattr(warc, "RANGE_PAGES", pages_a_range)
    html = ["<p>é" + "z" * 200 + str(k % 5) for k in range(60)] + [None, "", "short", "short", "a\r\n\r\nWARC/1.1\r\n" * 20, "y" * 99, "y" * 99, "w" * 100, "w" * 100]
    rows = [(k, f"http://h{k % 7}.org/p\n{k}" if k % 11 else None, h) for k, h in enumerate(html)] + [(None, "http://x", html[0]), (3, "http://x", html[3])] + [(9, "http://same/", "v" * 200_000)] * 30
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in CLASH}).repartition(4)
    got = warc.archive(pages).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        payload = (h or "").encode()
        again = len(payload) >= 100 and i != first[h]
        import hashlib

        want.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    same([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], want)
    keys = [warc._order((r["url_key"], r["time"], r["page_id"])) for r in sorted(got, key=lambda r: (r["range"], r["place"]))]
    assert keys == sorted(keys)
    assert (len({r["range"] for r in got}) > 5) == (pages_a_range == 5)  # one URL and time with many captures doesn't keep to one range
    assert warc.archive(pages.limit(0)).count() == 0


def test_loser_tree():
    draw = random.Random(1)
    for k in range(0, 9):
        runs = [sorted([(draw.choice("ab"), str(draw.randrange(9)), draw.choice([None, 1, 2])) for _ in range(draw.randrange(6))], key=warc._order) for _ in range(k)]
        assert [warc._order(r) for r in warc.LoserTree(runs)] == sorted(warc._order(x) for r in runs for x in r)


def test_decontamination(spark):
    item = "The shop of Mary Smith sold 12 kg of fresh apples for 30 dollars and 12 lemons to old Peter in the morning"
    bench = spark.createDataFrame([(1, item), (2, "only five plain words here"), (3, None), (4, "one two"), (5, "x y z " * 40)], "item_id long, text string").withColumn("row", F.lit(1))
    asked = [
        (1, "Foo bar. " + item.replace("12", "99").replace("Mary Smith", "Bob").replace("30", "41").replace("Peter", "Ann") + " and more", True),
        (2, item.replace("12 lemons", "13 lemons"), False), (3, "Before. " + item, True), (4, None, False), (5, "", False), (6, "The shop of the old town sold some fresh apples", False),
        (7, (item + ". ") * 300, True), (8, "We found only five plain words here today", True), (9, "nothing alike at all in these words", False), (None, item, True),
    ]
    docs = spark.createDataFrame([(i, t) for i, t, _ in asked], "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH + ["item_id"]})
    got = {r["doc_id"]: r["contaminated"] for r in decontamination.contaminated(docs, bench).collect()}
    assert {i: got[i] for i, _, bad in asked if i != 2} == {i: bad for i, _, bad in asked if i != 2}
    left = decontamination.clean(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, b in got.items() if not b}
    assert not any(r["contaminated"] for r in decontamination.contaminated(docs, bench.limit(0)).collect())
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0


def test_decontamination_where_sentences_open(spark):
    """Names that open sentences, short items in the midst of a sentence, items of numbers, names around a copy."""
    items = ["Tom has 3 apples. Mary has 5 pears. Bob has 7 plums.", "Which river flows through the old town", "Solve 12 + 7 = 19 and 3 x 4 = 12", "seventeen grey geese walked slowly home with Peter then Ann saw Peter"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    asked = [
        ("Ann has 4 apples. Paul has 6 pears. Sue has 9 plums.", [0]), ("Ann has 4 apples. Ann has 6 pears. Sue has 6 plums.", []), ("and so on Which river flows through the old town", [1]),
        ("first " + items[2] + " then", [2]), ("Solve 12 + 7 = 20 or 3 x 5 = 15", []), ("Then " + items[3] + " Smith and all", [3]), ("Ann had 4 apples. Paul ate 6 pears.", []),
    ]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(asked)], "doc_id long, text string")
    assert {r["doc_id"]: r["items"] for r in decontamination.contaminated(docs, bench).collect()} == {k: ids for k, (_, ids) in enumerate(asked)}


def forms_of(text):
    """(template token, slot or None) of each token in the three forms, by plain loops over the text's bytes."""
    units = set(decontamination.UNITS.split())
    found, opens, gap = [], [], True
    word = b""
    for byte in (text or "").encode() + b" ":
        c = bytes([byte])
        if c in b" \t\n\v\f\r":
            if word:
                found.append(word)
                opens.append(gap)
                gap, word = False, b""
            gap = gap or c == b"\n"
        elif byte >= 128 or c.isalnum():
            word += c
        else:
            if c in b".!?:":
                gap = gap or not word
                word = word + b"\0" if word else word
    # an end inside a word counts only if it stands after the word's last letter
    tail = [w.endswith(b"\0") for w in found]
    found = [w.replace(b"\0", b"") for w in found]
    opens = [i == 0 or opens[i] or tail[i - 1] for i in range(len(found))]
    low = [bytes(x + 32 if 65 <= x <= 90 else x for x in w).decode("utf-8", "surrogateescape") for w in found]
    kinds = []
    for i, w in enumerate(found):
        digits = sum(48 <= x <= 57 for x in w)
        capitals = sum(65 <= x <= 90 for x in w)
        number, measure = digits == len(w), 0 < digits < len(w)
        unit = low[i] in units and i > 0 and kinds[i - 1] == "N"
        first = 65 <= w[0] <= 90 or (w[0] == 0xC3 and len(w) > 1 and 0x80 <= w[1] <= 0x9E)
        name = first and not measure and len(w) > 1 and capitals < max(len(w), 2)
        kinds.append("X" if name else "M" if measure else "U" if unit else "N" if number else None)
    out = []
    for plain_openers in (True, False):
        tokens = []
        for i, w in enumerate(low):
            kind = kinds[i]
            if kind == "X" and plain_openers and opens[i]:
                kind = "U" if w in units and i > 0 and kinds[i - 1] == "N" else None
            follows = kind == "X" and tokens and tokens[-1][2] == i - 1 and tokens[-1][0] == "<X>" and not opens[i]
            if follows:
                tokens[-1] = ("<X>", tuple(sorted([*tokens[-1][1], w])), i)
            else:
                tokens.append((f"<{kind}>", (w,), i) if kind else (w, None, i))
        out.append([(t, s) for t, s, _ in tokens])
    return [*out, [(w, None) for w in low]]


def leaks(doc, item):
    """Whether the item leaks into the document: all windows of all forms by plain loops."""
    judged = reached = False
    for form, (d, t) in enumerate(zip(forms_of(doc), forms_of(item), strict=True)):
        k = min(decontamination.WINDOW, len(t))
        if k < decontamination.SHORTEST:
            continue
        fit = lambda x, i: i + k <= len(x) and sum(s is None for _, s in x[i : i + k]) >= min(decontamination.PLAIN, k - 1)  # noqa: B023, E731
        own = [i for i in range(len(t)) if fit(t, i)]
        if not own:
            continue
        whole = judged and form == decontamination.LITERAL
        judged = True
        by = collections.defaultdict(lambda: (set(), set()))
        for i in own:
            for j in range(len(d)):
                if fit(d, j) and [x for x, _ in d[j : j + k]] == [x for x, _ in t[i : i + k]]:
                    by[j - i][0].add(i)
                    by[j - i][1].update((t[i + x][1], d[j + x][1]) for x in range(k) if t[i + x][1] is not None)
        sound = {i for places, pairs in by.values() if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}) for i in places}
        reached = reached or (len(sound) >= max(1, len(own) * (1 if whole else decontamination.LEAST_SHARE)))
    return reached


@pytest.mark.parametrize("few", [True, False])
def test_decontamination_equals_brute_force(spark, monkeypatch, few):
    """Items with names, numbers and units, in documents that copy, re-parameterise, cut, shift and shuffle them."""
    if not few:
        monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
        monkeypatch.setattr(decontamination, "LEAST_BITS", 8)  # a nearly full bit table lets false hits through to the join
        monkeypatch.setattr(decontamination, "BITS_EACH", 1)
    draw = random.Random(12)
    plain = "the of buys sells house river old green walks then for with under bread sees".split()
    names, units = ["Ann", "Bob Lee", "Élan", "Tom", "Mary Ann Fox"], ["kg", "km", "dollars", "hours"]

    def sentence(n):
        out = []
        for _ in range(n):
            out.append(draw.choice([draw.choice(plain)] * 6 + [draw.choice(names), f"{draw.randrange(9)} {draw.choice(units)}", f"{draw.randrange(40)}kg", str(draw.randrange(5))]))
        return " ".join(out) + draw.choice([".", "?", "", ":"])

    items = [" ".join(sentence(draw.randrange(2, 9)) for _ in range(draw.randrange(1, 4))) for _ in range(25)] + ["a b", "", None, "12 13 14 15", "U.S. law: The old house Of Bob!"]
    docs = []
    for t in items:
        w = (t or "x").split()
        other = {x: draw.choice(names) for x in names} | {str(k): str(draw.randrange(5)) for k in range(5)}
        docs += [sentence(5) + " " + (t or "") + " " + sentence(5), " ".join(other.get(x, x) for x in w), " ".join(w[: len(w) // 2 + 1]), " ".join(w[2:]), (t or "").lower(), " ".join(draw.sample(w, len(w)))]
    docs += [sentence(30) for _ in range(40)] + [None, "", " ".join(x for x in items if x) * 5, *[x for x in items if x]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH + ["h", "place", "items", "_part"]}).repartition(3)
    got = {r["doc_id"]: r["items"] for r in decontamination.contaminated(rows, bench).collect()}
    want = {i: [k for k, t in enumerate(items) if leaks(d, t)] for i, d in enumerate(docs)}
    assert {i: (got[i], want[i], docs[i]) for i in want if got[i] != want[i]} == {}
    assert sum(map(bool, want.values())) > 40 and not all(want.values())


def test_decontamination_of_long_and_repeated_texts(spark):
    item = "old Peter sold fresh apples and sweet lemons to the tall man of the green house"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "filler words here " * 150_000 + item), (2, item), (2, item), (3, "filler words here " * 150_000)], "doc_id long, text string")
    same([(r["doc_id"], r["contaminated"]) for r in decontamination.contaminated(docs, bench).collect()], [(1, True), (2, True), (2, True), (3, False)])
    assert [r["doc_id"] for r in decontamination.clean(docs, bench).select("doc_id").collect()] == [3]


def test_without_many_ids(spark, monkeypatch):
    """Rows left out by a shuffle where there are too many ids to broadcast; null is an id."""
    from cinderflow import storage

    df = spark.createDataFrame([(k if k % 7 else None, k) for k in range(300)], "doc_id long, x long")
    away = spark.createDataFrame([(k,) for k in range(0, 300, 2)] + [(None,)], "doc_id long")
    want = [k for k in range(300) if k % 7 and k % 2]
    for limit in (500_000, 10):
        monkeypatch.setattr(storage, "BROADCAST_IDS", limit)
        assert sorted(r["x"] for r in storage.without(df, away, "doc_id").collect()) == want


def test_inconsistent_slots_do_not_match(spark):
    bench = spark.createDataFrame([(1, "if a train takes 12 minutes and a bus takes 40 minutes then the train is faster than the bus by far")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "if a train takes 7 minutes and a bus takes 7 minutes then the train is faster than the bus by far"), (2, "if a train takes 7 minutes and a bus takes 9 minutes then the train is faster than the bus by far")], "doc_id long, text string")
    assert {r["doc_id"]: r["contaminated"] for r in decontamination.contaminated(docs, bench).collect()} == {1: False, 2: True}


def test_class_lm(spark, docs):
    got = class_lm.score(docs).collect()
    rows = rows_of(docs)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count, n_train = collections.Counter(), 0
    for i, t in rows:
        if not held(i):
            count.update(words(t))
            n_train += 1
    total, kinds = sum(count.values()) + n_train, len(count) + 1
    log = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    want = [(i, held(i), len(words(t)) + 1, sum(w in count for w in words(t)) + 1, total, round(sum(log(count[w]) for w in words(t)) + log(n_train), 6)) for i, t in rows]
    same([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got], want)
    assert all(r["score"] < 0 for r in got)
    h = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in h) > sum(r["base_score"] for r in h)
    assert class_lm.score(docs.limit(0)).count() == 0
    alone = class_lm.score(docs.where("doc_id = 4")).collect()
    assert len(alone) == 1 and math.isfinite(alone[0]["score"])


def key_of(word):
    """The word's hash as the model keeps it."""
    data, offsets = class_lm.K.flat(pa.array([word]))
    w = class_lm.K.words(data, offsets)
    return int((w.hash & ~np.uint64(3) | class_lm._shape(data, w).astype(np.uint64)).view(np.int64)[0])


def model_of(docs):
    rows = class_lm.coded(docs)
    m = class_lm.learn(rows, docs.where(~class_lm.held_out(F.col("doc_id"))).count())
    told = class_lm.resolved(rows, m, 1)
    return m, {r["word"]: (r["n"], r["cls"]) for r in m.words.collect()}, class_lm.transitions(told, m.end)


def test_class_lm_scores_equal_brute_force(spark, docs):
    """Transitions counted and texts scored by plain loops from the model's classes, words beyond the broadcast ones too."""
    for top in (class_lm.TOP, 40):
        saved, class_lm.TOP = class_lm.TOP, top
        m, words_, moves = model_of(docs)
        got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in class_lm.score(docs).collect()}
        class_lm.TOP = saved
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        cls = lambda w: words_.get(key_of(w), (0, m.classes + (key_of(w) & 3)))
        count, totals = np.full((m.end + 1, m.end + 1), class_lm.ADD), collections.Counter()
        for n, c in words_.values():
            totals[c] += n + class_lm.ADD
        for s in range(class_lm.SHAPES):
            totals[m.classes + s] += class_lm.ADD
        path = lambda t: [m.end, *(cls(w)[1] for w in words(t)), m.end]
        some = [(i, t) for i, t in rows_of(docs) if len(t or "") < 2000]
        for i, t in rows_of(docs):
            if not held(i):
                p = path(t)
                np.add.at(count, (p[:-1], p[1:]), 1)
        want = np.log10(count / count.sum(1, keepdims=True))
        assert np.allclose(want, moves)
        for i, t in some:
            p = path(t)
            score = sum(want[a, b] for a, b in zip(p[:-1], p[1:], strict=True)) + sum(math.log10((cls(w)[0] + class_lm.ADD) / totals[cls(w)[1]]) for w in words(t))
            assert math.isclose(got[i, len(p) - 1], score, rel_tol=1e-6, abs_tol=1e-6), (i, t)


def test_class_lm_is_a_distribution(spark):
    """Over known and unknown words the model's next-token probabilities add up to 1."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b a c", "b a b", "c a b a", "d! é b"] * 3)], "doc_id long, text string")
    m, words_, moves = model_of(docs)
    p_class = 10 ** moves[m.end]
    known = sum(p_class[c] * (n + class_lm.ADD) / 10 ** m.total[c] for n, c in words_.values())
    unknown = sum(p_class[m.classes + s] * class_lm.ADD / 10 ** m.total[m.classes + s] for s in range(class_lm.SHAPES))
    empty = sum(p_class[c] for c in range(m.classes) if not any(k == c for _, k in words_.values()))
    assert math.isclose(known + unknown + empty + p_class[m.end], 1, rel_tol=1e-9)


def test_sweeps_class_the_whole_vocabulary(spark, monkeypatch):
    """Words beyond the seeds and beyond the broadcast ones are classed by their contexts: nouns with nouns, verbs with verbs."""
    monkeypatch.setattr(class_lm, "SEEDS", 20)
    monkeypatch.setattr(class_lm, "TOP", 60)
    monkeypatch.setattr(class_lm, "classes_for", lambda n: 2)
    draw = random.Random(8)
    pick = lambda kind: f"{kind}{min(int(draw.expovariate(0.03)), 199)}"
    docs = spark.createDataFrame([(k, " ".join(pick("nv"[j % 2]) for j in range(30))) for k in range(500)], "doc_id long, text string")
    m, words_, _ = model_of(docs)
    kinds = {k: collections.Counter(words_[key_of(f"{k}{i}")][1] for i in range(200) if words_.get(key_of(f"{k}{i}"), (0, 9))[0] >= class_lm.LEAST_COUNT) for k in "nv"}
    assert len(words_) > 150 and len(m.top) < 100
    noun, verb = (kinds[k].most_common(1)[0] for k in "nv")
    # A rare word may have no neighbour among the top ones.
    assert noun[0] != verb[0] and noun[1] >= 0.95 * kinds["n"].total() and verb[1] >= 0.95 * kinds["v"].total(), kinds


def test_contexts_are_all_neighbours(spark, monkeypatch):
    """Contexts beyond the words that tasks hold count too: classes don't depend on TOP, and class bigrams are those of the whole text, rare words' shapes included."""
    monkeypatch.setattr(class_lm, "SEEDS", 20)
    monkeypatch.setattr(class_lm, "SWEEPS", 2)
    monkeypatch.setattr(class_lm, "classes_for", lambda n: 6)
    draw = random.Random(9)
    pick = lambda kind: f"{kind}{min(int(draw.expovariate(0.02)), 199)}"
    docs = spark.createDataFrame([(k, " ".join([pick("nv"[j % 2]) for j in range(30)] + [f"once{k}", f"é{k}!"])) for k in range(500)] + [(501, ""), (502, None)], "doc_id long, text string")
    found = {}
    for top in (60, 65_536):
        monkeypatch.setattr(class_lm, "TOP", top)
        m, found[top], _ = model_of(docs)
        assert len(m.top) <= top
    assert found[60] == found[65_536]
    clustered = {w: c for w, (n, c) in found[60].items() if n >= class_lm.LEAST_COUNT}
    assert len(clustered) > 150 and len(found[60]) > 900
    rows = class_lm.coded(docs)
    vocabulary = spark.createDataFrame([(w, n, False, c) for w, (n, c) in found[60].items() if w in clustered], "word long, n long, hot boolean, cls int")
    top = np.sort(np.array(list(clustered)[:30], np.int64).view(np.uint64))
    table = class_lm._bit_table(vocabulary, len(clustered))
    known = class_lm.contexts(rows, vocabulary, top, np.array([clustered[w] for w in top.view(np.int64).tolist()]), 6, table, True, 3)
    got = class_lm.class_bigrams(known, 6)
    want, end = np.zeros_like(got), 6 + class_lm.SHAPES
    for r in docs.where(~class_lm.held_out(F.col("doc_id"))).collect():
        w = [key_of(x) for x in words((r["text"] or "").lower())]
        c = [found[60][x][1] for x in w]
        for x, y, i, j in zip([None, *w], [*w, None], [end, *c], [*c, end], strict=True):
            want[i, j] += x != y and (i < 6 or j < 6)
    assert (got == want).all()


def test_bit_table_has_every_word(spark):
    draw = np.random.default_rng(2)
    words_ = np.unique(draw.integers(-(2**63), 2**63, 3000, dtype=np.int64))
    table = class_lm._bit_table(spark.createDataFrame([(int(w),) for w in words_], "word long"), len(words_))
    assert class_lm._in_table(table, words_.view(np.uint64)).all()
    assert class_lm._in_table(table, draw.integers(0, 2**63, 10_000, dtype=np.int64).view(np.uint64)).mean() < 0.1
    assert not class_lm._in_table(class_lm._bit_table(spark.createDataFrame([], "word long"), 0), words_.view(np.uint64)).any()


def test_frequent_words_never_exceed_their_number(spark):
    counts = spark.createDataFrame([(k, 1 + k % 7) for k in range(3000)], "word long, n long")
    for most in (0, 10, 400, 429, 2000, 3000, 9999):
        got = counts.where(class_lm.frequent(counts, most)).collect()
        assert len(got) <= most and len(got) >= min(3000, most) - 6 * most**0.5 - 30
        assert not got or min(r["n"] for r in got) >= 7 - math.ceil(most / 428)


def test_exchange_finds_classes():
    n = np.zeros((40, 40))
    for i in range(40):
        for j in range(40):
            n[i, j] = 50 if (i < 20) == (j >= 20) else 1
    cls = class_lm.exchange(n, 2)
    assert len(set(cls[:20])) == 1 and len(set(cls[20:])) == 1 and cls[0] != cls[20]


def test_gains_equal_the_likelihood():
    """Gains of every class against the likelihood computed anew, for a word in no class and for one that its class counts."""
    draw = np.random.default_rng(3)
    m, k = 30, 5
    big = draw.integers(0, 20, (m, m)) * (1 - np.eye(m, dtype=int))
    cls = draw.integers(0, k, m)

    def bits(c):
        one = np.eye(k + 1)[c]
        n = one.T @ big @ one
        return n, class_lm._xlogx(n).sum() - class_lm._xlogx(n.sum(1)).sum() - class_lm._xlogx(n.sum(0)).sum()

    for w in range(m):
        after, before = np.bincount(cls, big[w], k + 1), np.bincount(cls, big[:, w], k + 1)
        whole = []
        for j in range(k):
            c = cls.copy()
            c[w] = j
            whole.append(bits(c)[1])
        n = bits(cls)[0]
        own = int(cls[w])
        rest = n.copy()
        rest[own] -= after
        rest[:, own] -= before
        for got in (class_lm.Bigrams(rest).gains(after, before, -1), class_lm.Bigrams(n).gains(after, before, own)):
            assert np.allclose(got - got[0], np.array(whole) - whole[0])


def test_quality_rules(spark, docs):
    got = quality_rules.judge(docs).collect()

    def brute(t):
        w = re.findall(SPACE, t or "")
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(SPACE, line):
                dup += line in lines
                lines.add(line)
        return len(w), sum(map(len, re.findall(SPACE, t or ""))), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)

    want = []
    for i, t in rows_of(docs):
        b = brute(t)
        want.append((i, *b, b[0] < 20 or 100 * b[4] > 30 * b[0]))
    same([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got], want)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert np.mean([r["kept"] for r in got if not r["base_failed"]]) > 0.9
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_mcd_rejects_outliers(spark):
    draw = random.Random(2)
    plain = [" ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9))) for _ in range(100)) + ". And so on, it is." for _ in range(300)]
    odd = [" ".join("|" + draw.choice("abcdefghij") * draw.randrange(12, 30) for _ in range(100)) for _ in range(20)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(plain + odd)], "doc_id long, text string, lang string, source string")
    for few in (True, False):
        limit = quality_rules.BROADCAST_POOLS
        quality_rules.BROADCAST_POOLS = limit if few else 0
        kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
        quality_rules.BROADCAST_POOLS = limit
        assert all(kept[k] for k in range(300)) and not any(kept[k] for k in range(300, 320))


def test_mcd_equals_a_search(spark):
    """The held half's determinant against the best of many random starts by plain numpy, and the distances that follow."""
    draw = np.random.default_rng(5)
    groups, d = {}, quality_rules.D
    for g, n, bad in (("a", 90, 0.3), ("b", 200, 0.1), ("c", 40, 0.25)):
        mix = draw.normal(size=(d, d)) / 3 + np.eye(d)
        x = draw.normal(size=(n, d)) @ mix
        x[: int(n * bad)] += 9
        groups[g] = x
    rows = [(g, *map(float, v)) for g, x in groups.items() for v in x]
    vectors = spark.createDataFrame(rows, "g string, " + ", ".join(f"v{i} double" for i in range(d)))
    found = {r["g"]: r for r in quality_rules.determinants(vectors, True).collect()}
    for g, x in groups.items():
        n = len(x)
        share = next(p for p in quality_rules.HELD if p >= (n + d + 1) / (2 * n) - 1e-9)
        h = int(np.ceil(share * n - 1e-9))
        scatter = lambda held: np.cov(held.T, bias=True) * quality_rules.consistency(h / n, d) + quality_rules._FLOOR  # noqa: B023, E731
        best = np.inf
        for _ in range(200):
            held = x[draw.permutation(n)[: d + 1]]
            for _ in range(20):
                off = x - held.mean(0)
                held = x[np.argsort(((off @ np.linalg.inv(scatter(held))) * off).sum(1))[:h]]
            best = min(best, np.linalg.slogdet(scatter(held))[1])
        # Three starts in eight dimensions may end in a neighbouring minimum.
        assert found[g]["logdet"] <= best + 0.6, g
        off = x - np.array(found[g]["mu"])
        far = ((off @ np.linalg.inv(quality_rules._matrix(found[g]["cov"]))) * off).sum(1)
        bad = {"a": 27, "b": 20, "c": 10}[g]
        assert far[:bad].min() > 100 and np.median(far[bad:]) < 15


def test_small_groups_lean_on_their_language(spark):
    """Three texts of a source alone in it are judged, by their language's measure; equal texts are kept; a null source is a source."""
    draw = random.Random(6)
    text = lambda: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9))) for _ in range(100)) + ". And so on, it is."
    odd = " ".join("|" + draw.choice("abcdefghij") * draw.randrange(12, 30) for _ in range(100))
    rows = [(k, text(), "en", "big") for k in range(200)] + [(200, text(), "en", None), (201, text(), "en", None), (202, odd, "en", None), (203, odd, "en", "lone"), (204, text(), "de", "lone")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept[200] and kept[201] and not kept[202] and not kept[203] and kept[204]
    equal = [(k, "one two three four five six seven eight nine ten " * 2 + "eleven", "en", "s") for k in range(30)]
    assert all(r["kept"] and r["distance"] < 1e-9 for r in quality_rules.judge(spark.createDataFrame(equal, "doc_id long, text string, lang string, source string")).collect() if not r["base_failed"])


@pytest.mark.parametrize("alike", [False, True])
def test_mcd_rejects_a_third(spark, alike):
    """Junk that holds a third of one pool, as different texts or as copies of one, doesn't set the measure."""
    draw = random.Random(3)
    plain = [" ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9))) for _ in range(100)) + ". And so on, it is." for _ in range(300)]
    odd = [" ".join("|" + draw.choice("abcdefghij") * draw.randrange(12, 30) for _ in range(100)) for _ in range(150)]
    odd = odd[:1] * 150 if alike else odd
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(plain + odd)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    assert not any(kept[k] for k in range(300, 450)) and sum(kept[k] for k in range(300)) >= 290


def test_token_ids(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = token_ids.write_and_read(docs).collect()
    each = []
    for i, t in rows_of(docs):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        each.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], each)
    ordered = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)
    assert token_ids.write_and_read(docs.limit(0)).count() == 0


def test_token_files_hold_the_exact_bytes(spark, docs, tmp_path):
    """Blocks are no UTF-8: what stands in the files must be what the reader's layout says, byte for byte, and documents in order over files."""
    import public_tokenizers

    path = f"file://{tmp_path}/ids"
    same_id = docs.select(F.when(F.col("doc_id") % 2 == 0, 7).otherwise(F.col("doc_id")).alias("doc_id"), "text")
    token_ids.write(same_id, path, str(public_tokenizers.path("word_bpe_49k.json")))
    total, shards = 0, set()
    for f in sorted((tmp_path / "ids" / "blocks").glob("part-*")):
        content = f.read_bytes()
        for shard, _, found, control, data in token_ids.parse(content):
            shards.add(shard)
            lengths = token_ids.LENGTHS[control].sum()
            pads = (-found["n"].astype(int) % 4).sum()
            assert len(data) == lengths - pads  # padded places have length 1
            total += len(found)
    assert total == docs.count() and len(shards) > 1
    ranks = b"".join(f.read_bytes() for f in (tmp_path / "ids" / "ranks").glob("part-*"))
    assert ranks[:4] == b"CFTR" and len(ranks) == 8 + 4 * int.from_bytes(ranks[4:8], "little") + 1


def test_wide_ids_round_trip():
    """Ids that two bytes don't hold."""
    whole = token_ids.encode_column

    def shifted(path, column):
        flat, starts = whole(path, column)
        return flat + np.uint32(70_000), starts

    flat, starts = shifted(token_ids_path(), pa.array(["a b c", "", "dé f"]))
    packed = [token_ids.pack(flat[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    join = lambda k: np.frombuffer(b"".join(p[k] for p in packed), np.uint8)
    assert (token_ids.unpack(join(0), join(1), np.diff(starts)) == flat).all() and flat.min() > 0xFFFF


def token_ids_path():
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def test_token_coding_round_trip():
    draw = np.random.default_rng(5)
    lists = [draw.integers(0, 2 ** int(draw.integers(1, 32)), int(draw.integers(0, 60)), dtype=np.uint32) for _ in range(200)]
    packed = [token_ids.pack(x) for x in lists]
    join = lambda k: np.frombuffer(b"".join(p[k] for p in packed), np.uint8)
    out = token_ids.unpack(join(0), join(1), np.array([len(x) for x in lists]))
    assert (out == np.concatenate(lists)).all()


def test_fast_words_equal_the_tokenizer():
    import public_tokenizers
    import pyarrow as pa

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    found = ["It's", "DON'T", "É", "straße", "<|endoftext|>", "x<|startoftext|>y", "a<|", "İst", "ΑΣ.", "123abc", "4.5,", "日本。", "été!?", "x" * 3000, "ﬁ", "a.\u0301", "b!\u0300", "''s", "e\u0301x", "÷a", "ª"]
    ids, at = token_ids.encode_distinct(path, pa.array(found, pa.large_string()))
    for k, w in enumerate(found):
        assert ids[at[k] : at[k + 1]].tolist() == token_ids._tokenizer(path).encode(w, add_special_tokens=False).ids, w


def test_quality_classifier(spark):
    draw = random.Random(4)
    good = [" ".join(draw.choice(["the", "of", "house", "tree", "and", "river", "is", "green"]) + ("." if k % 9 == 8 else "") for k in range(80)) for _ in range(150)]
    bad = [" ".join(draw.choice(["###", "$$$", "AAA", "b|c", "%%"]) for _ in range(60)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(good + bad)]
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (None, good[0]), rows[0]], "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH})
    labels = spark.createDataFrame([(k, int(k < 150), 0) for k, _ in rows] + [(None, 1, 0), (5, None, 0), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 9000]
    assert np.mean([r["predicted"] == int(r["doc_id"] < 150) for r in held]) > 0.97
    stay = quality_classifier.accepted(docs, labels)
    assert stay.columns == docs.columns
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {1}


def test_quality_classifier_edges(spark):
    """Labels of documents that are not there don't crowd out the others; one label only, very long and empty texts, extra columns."""
    docs = spark.createDataFrame([(k, "plain words of good prose, you see. " * 20 if k % 2 else "|| ## $$ " * 40, "x", "y") for k in range(200)], "doc_id long, text string, __score string, __text string")
    here = [(k, k % 2) for k in range(200)]
    absent = [(10_000 + k, k % 2) for k in range(4000)]
    labels = spark.createDataFrame(here + absent, "doc_id long, quality int")
    m = quality_classifier.train(docs, labels, sample=100)
    assert np.abs(m.weights).sum() > 0
    got = {r["doc_id"]: r["predicted"] for r in quality_classifier.classify(docs, labels).collect()}
    assert got == dict(here)
    single = spark.createDataFrame([(k, 1) for k in range(200)], "doc_id long, quality int")
    assert {(r["score"], r["predicted"]) for r in quality_classifier.classify(docs, single).collect()} == {(0.5, 1)}
    odd = spark.createDataFrame([(1, "word " * 400_000), (2, None), (None, ""), (1, "word " * 400_000)], "doc_id long, text string")
    found = quality_classifier.classify(odd, labels).collect()
    assert len(found) == 4 and len({r["score"] for r in found if r["doc_id"] == 1}) == 1
    assert quality_classifier.accepted(docs, labels).columns == docs.columns


def test_bradley_terry_fit_equals_gradient_descent():
    """The fitted weights are at the minimum of the loss, as plain gradient steps over the same pairs find it."""
    draw = np.random.default_rng(1)
    x = draw.normal(size=(300, 3))
    label = (x @ np.array([2.0, -1.0, 0.0]) + draw.normal(size=300) > 0).astype(int)
    m = quality_classifier.fit(x, label, pairs=2000)
    z = np.clip((x - m.mean) / m.scale, -8, 8)
    good, bad = z[label == 1], z[label == 0]
    w = np.zeros(3)
    for _ in range(3000):  # the expected loss over all pairs: the drawn ones differ from it by their draw only
        d = good[:, None] - bad[None]
        p = 1 / (1 + np.exp(d @ w))
        w += 0.5 * ((d * p[..., None]).mean((0, 1)) - quality_classifier.RIDGE * w)
        if np.abs((d * p[..., None]).mean((0, 1)) - quality_classifier.RIDGE * w).max() < 1e-4:
            break
    assert np.abs(w - m.weights).max() < 0.25 and m.weights[0] > 1 > 0 > m.weights[1]


def license_texts():
    """Whole wordings, and variants: words put in, left out or replaced, the key phrase left out, pieces, two in one text, case."""
    draw, out = random.Random(9), []
    filler = lambda n: " ".join(draw.choice(["sun", "file", "house", "without", "software", "copy", "modify", "über"]) for _ in range(n))
    for label, key, text in license_scans.TEMPLATES:
        w = text.split()
        fewer = [x for k, x in enumerate(w) if k % 9 != 5]
        more = [y for k, x in enumerate(w) for y in ([x, "indeed"] if k % 11 == 3 else [x])]
        for body in (text, text.upper(), " ".join(fewer), " ".join(more), " ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :]), " ".join(reversed(w)), text.lower().replace(key.split()[0], "x")):
            out.append(f"{filler(draw.randrange(30))} {body} {filler(draw.randrange(30))}")
    wording = {label: text for label, _, text in reversed(license_scans.TEMPLATES)}
    out += [wording["mit"] + " and " + wording["apache"], "software " * 3000, wording["mit"] * 10]
    out.append("Permission is granted, free of charge, to any person obtaining a copy of this software and associated documentation files")
    return out


def brute_licenses(texts):
    """labels and score of each text: every offset bin of every template by plain loops."""
    W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    cut = [re.findall(W, (t or "").translate(LOWER)) for t in texts]
    known = set(license_scans.vocabulary())
    held = collections.Counter(x for w in cut for x in set(w) & known)
    idf = {x: license_scans.idf(held[x], len(texts)) for x in known}
    rows = license_scans.index_rows()
    indexed = {x for x, *_ in rows}
    out = []
    for w in cut:
        labels = {label for phrase, label in license_scans.BASE.items() if f" {phrase} " in f" {' '.join(w)} "}
        chosen = set(sorted(set(w) & indexed, key=lambda x: (-idf[x], x))[: license_scans.LOOKED_UP])
        spots = [(i, x) for i, x in enumerate(w) if x in chosen]
        best_score = 0.0
        for t, (label, key, text) in enumerate(license_scans.TEMPLATES):
            told = license_scans.words_of(text)
            own, bins = collections.defaultdict(list), collections.defaultdict(set)
            for x, of, place in rows:
                if of == t:
                    own[x].append(place)
            if len(chosen & set(own)) < min(license_scans.LEAST_WORDS, len(own)):
                continue
            for at, x in spots:
                for place in own.get(x, ()):
                    for shift in (0, license_scans.SLACK // 2):
                        bins[(at - place + shift) // license_scans.SLACK * license_scans.SLACK - shift].add(x)
            every, need = sum(idf[x] for x in chosen & set(own)), min(license_scans.PLACES, len(own))
            shares = sorted((-round(sum(idf[x] for x in xs) / every * min(1, len(xs) / need), 9), low) for low, xs in bins.items() if len(xs) >= min(license_scans.LEAST_WORDS, len(own)))
            if shares:
                share, low = -shares[0][0], shares[0][1]
                best_score = max(best_score, min(1.0, share))
                k = key.split()
                here = [i for i in range(len(w)) if w[i : i + len(k)] == k]
                if share >= license_scans.LEAST_SHARE and any(low - license_scans.MARGIN <= i <= low + len(told) + license_scans.MARGIN for i in here):
                    labels.add(label)
        out.append((",".join(sorted(labels)), round(best_score, 6)))
    return out


def test_license_scans_equal_brute_force(spark, docs):
    some = license_texts() + [t for t in texts() if len(t or "") < 20_000]
    rows = list(enumerate(some))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH + ["met", "base", "keys", "labels"]}).repartition(5)
    got = {r["doc_id"]: (r["labels"], round(r["score"], 6)) for r in license_scans.scan(df).collect()}
    want = dict(enumerate(brute_licenses(some)))
    assert got == want
    n, found, planted = len(license_scans.TEMPLATES), 0, 0
    for t, (label, key, _) in enumerate(license_scans.TEMPLATES):
        for k in range(6):  # whole, upper case, words left out, words put in, first and second half
            if f" {key} " in f" {' '.join(license_scans.words_of(some[8 * t + k]))} ":
                planted += 1
                found += label in got[8 * t + k][0].split(",")
        assert label in got[8 * t][0].split(",") and label in got[8 * t + 1][0].split(",")
    assert found >= 0.9 * planted and planted > 4 * n  # recall on cut and edited licences
    assert got[8 * n][0] == "apache,mit" and got[8 * n + 1] == ("", 0.0) and got[8 * n + 3][1] > 0


def test_licenses_cut_short(spark):
    """Openings, titles and notices, in a corpus in which most words of a licence never occur."""
    cut = {
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted", "agpl": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\nCopyright (C) 2007 Free Software Foundation, Inc.",
        "lgpl": "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1", "apache": "Apache License\nVersion 2.0, January 2004\nTERMS AND CONDITIONS FOR USE",
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy", "zlib": "to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented",
    }
    clean = ["We hold the software of this person and the copies of that document, without permission.", "The license of the house, granted free, is general and public.", "source files, binary forms, permitted copies"]
    rows = list(enumerate([*cut.values(), *clean, *(f"nothing to see {k}" for k in range(30))]))
    got = {r["doc_id"]: r["labels"] for r in license_scans.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {label: label in got[i].split(",") for i, label in enumerate(cut)} == dict.fromkeys(cut, True)
    assert {got[i] for i in range(len(cut), len(rows))} == {""}


def test_license_scans(spark, docs):
    got = license_scans.scan(docs).collect()
    want = []
    for i, t in rows_of(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at, labels = [], set()
        for phrase, label in license_scans.BASE.items():
            p = phrase.split()
            here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    same([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got], want)
    for r in got:
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert license_scans.scan(docs.limit(0)).count() == 0
