"""License, token, secret and URL operators against plain versions."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from rolemeter.llm import licenses, secrets, tokens, urls
from tests.llm.helpers import ODD, empty, frame, odd, rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return len(words), sorted(found)


def test_license_bases_equal_a_plain_search(spark):
    r = random.Random(3)
    pieces = ["under", "the", "MIT", "license", "apache", "Version", "2", "2.0", "cc", "BY", "nc", "ccc", "é", "-", "\n", ", ", "x"]
    texts = [*ODD, *("".join(r.choice(pieces) + r.choice([" ", "-", "", "  "]) for _ in range(60)) for _ in range(200))]
    docs = frame(spark, texts)
    found = licenses.license_scan(docs)
    for doc, n, hits in rows(found):
        n_words, base = plain_base(texts[doc])
        assert n == n_words and sorted((h.word, h.label) for h in hits if h.base) == base


def test_license_rules():
    scanner = licenses.Scanner()
    assert len(scanner.rules) > 200 and all(r.keyword for _, r in scanner.rules)
    labels = lambda t: [(d["label"], d["rule"]) for d in scanner.scan(t)[1]]
    assert labels("SPDX-License-Identifier: GPL-2.0-or-later") == [("gpl-2", "tag:gpl-2.0-or-later")]
    assert labels("distributed under the terms of the GNU Lesser General Public License, version 2.1") == [("lgpl-2", "notice:lgpl-2:gnu")]
    # inside the notice, the name alone is suppressed
    assert labels("Released under the Mozilla Public License, v. 2.0") == [("mpl-2", "notice:mpl-2:mozilla public")]
    assert labels("see https://creativecommons.org/licenses/by-sa/4.0/") == [("cc-by-sa", "address:cc-by-sa")]
    assert labels("nothing to see here, mit freundlichen Grüßen") == []


def test_better_detections_suppress_what_lies_inside():
    kept = licenses.resolve([(0, 10, 2, 0, "a"), (2, 8, 4, 1, "b"), (2, 12, 4, 2, "c"), (0, 10, 2, 3, "d"), (3, 5, 0, 4, "base"), (0, 20, 4, 5, "e")])
    assert [x[4] for x in kept] == ["e", "a", "base"]


def test_license_scan_of_odd_and_no_rows(spark):
    found = licenses.license_scan(odd(spark))
    assert found.count() == len(ODD) + 2 and found.where("n_words is null or detections is null").isEmpty()
    assert licenses.license_scan(empty(spark)).isEmpty()
    assert licenses.license_scan(frame(spark, ["x y"]), keep=("doc_id", "size", "body")).columns == ["doc_id", "size", "body", "n_words", "detections"]


def plain_tokens(encoder, text, spans, rule):
    """Every byte of the text asked which token and which section it is in."""
    data = text.encode()
    place = [len(text[:i].encode()) for i in range(len(text) + 1)]
    owner = [None] * len(data)
    for k, (s, e) in enumerate(spans):
        for b in range(place[s], place[e]):
            owner[b] = k
    out, at = {k: 0.0 for k in [*range(len(spans)), None]}, 0
    for n in (int(encoder.lengths[i]) for i in encoder.encode(text)):
        owners = owner[at : at + n]
        at += n
        if rule == "first":
            out[owners[0]] += 1
        elif rule == "share":
            for o in owners:
                out[o] += 1 / n
        else:
            best = max(set(owners) - {None}, key=lambda o: (owners.count(o), -o), default=None)
            out[best if best is not None and owners.count(best) >= owners.count(None) else None] += 1
    return out


@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens_equal_a_count_byte_by_byte(spark, rule):
    from pyspark.sql import functions as F

    r = random.Random(7)
    texts = ["", "Hello wörld, naïve 𝔘𝔫 text\nwith lines", *("".join(r.choice("ab éß𝔘 \n.,x") for _ in range(80)) for _ in range(60))]
    spans = []
    for t in texts:
        cuts = sorted(r.sample(range(len(t) + 1), min(6, len(t) + 1) // 2 * 2))
        spans.append(list(zip(cuts[::2], cuts[1::2], strict=True)))
    docs = spark.createDataFrame(list(enumerate(zip(texts, spans, strict=True))), "doc_id long, row struct<text:string,spans:array<struct<start:long,end:long>>>").select("doc_id", "row.*")
    found = tokens.section_tokens(docs, F.col("spans"), rule=rule)
    encoder = tokens.Encoder(tokens.vocabulary())
    got = {}
    for doc, section, _, _, n, _ in rows(found):
        got.setdefault(doc, {})[None if section < 0 else section] = n
    for i, t in enumerate(texts):
        want = plain_tokens(encoder, t, spans[i], rule)
        assert {k: v for k, v in got.get(i, {}).items() if v} == pytest.approx({k: v for k, v in want.items() if v})


def test_lines_hold_all_tokens(spark):
    found = tokens.section_tokens(odd(spark))
    encoder = tokens.Encoder(tokens.vocabulary())
    sums = {r[0]: r[1] for r in rows(found.groupBy("doc_id").sum("n_tokens"))}
    for i, t in enumerate(ODD):
        assert sums.get(i, 0) == len(encoder.encode(t or "")) * (2 if i == 6 else 1)
    assert found.where("doc_id = 2").count() == 2 and found.where("section < 0").isEmpty()
    assert tokens.section_tokens(empty(spark)).isEmpty()


def plain_secrets(text):
    t, found = text or "", []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end()))
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, t) if m.end() - m.start() >= least]
    return sorted(found)


def test_secret_bases_equal_a_plain_search(spark):
    r = random.Random(11)
    pieces = ["Token", "API_KEY", "secret", "ſecret", " = ", ":", "'", '"', "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", " ", "x", "passwd", "a.b-c_d/e+f="]
    texts = [*ODD, *("".join(r.choice(pieces) for _ in range(40)) for _ in range(300))]
    for doc, spans in rows(secrets.secret_scan(frame(spark, texts))):
        assert [tuple(s) for s in spans if s.kind < 3] == plain_secrets(texts[doc])


def test_random_strings_are_found_and_words_are_not(spark):
    r = random.Random(5)
    code = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    planted = [f"the key {code(base64, 40)} is here" for _ in range(60)] + [f"or {code(base64[:62], 32)} here" for _ in range(60)]
    words = [w + x for w in ("characteristically", "internationalization", "ThisIsAVeryLongIdentifierName") for x in ("", "forever", "andmorewords")]
    plain = [f"some {w}{w} words" for w in words] * 40 + ["abcdefghijklmnopqrstuvwxyz0123456789", "1" * 60, "ab" * 40, "/usr/local/lib/python/site-packages/numpy"]
    found = {d: [tuple(s) for s in spans] for d, spans in rows(secrets.secret_scan(frame(spark, planted + plain)))}
    assert sum(bool(found[i]) for i in range(len(planted))) >= 0.95 * len(planted)
    # long runs of hex digits are spans of the fixed pattern, however regular
    assert sum(any(k == 3 for _, k, _ in found[i + len(planted)]) for i in range(len(plain))) == 0
    start, kind, end = next(found[i][0] for i in range(60) if found[i])
    assert (kind, start, end) == (3, 8, 48)


def test_secret_query_columns(spark, tmp_path):
    r = random.Random(12)
    pieces = ["token=", "abcdef", "password: x9", "AKIA", "ABCDEFGH12345678Z", "0123456789abcdef", "deadbeefdeadbeef", " ", "\n", "é", "𝔘"]
    texts = [*ODD, *("".join(r.choice(pieces) for _ in range(30)) for _ in range(200))]
    frame(spark, texts).unionByName(odd(spark).where("doc_id IS NULL OR doc_id = 6")).write.parquet(str(tmp_path / "documents.parquet"))
    names = ("assign", "access", "hex")
    found = secrets.op4_secrets(spark, str(tmp_path)).collect()
    assert len(found) == len(texts) + 3
    for x in found:
        spans = plain_secrets("no id here but some words" if x["doc_id"] is None else texts[x["doc_id"]])
        listed = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
        assert [x["n_assign"], x["n_access"], x["n_hex"]] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert x["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        every = [tuple(p.split(":")) for p in x["spans"].split(",") if p]
        assert ",".join(":".join(p) for p in every if p[0] != "random") == listed
        order = [(int(s), ("assign", "access", "hex", "random").index(k)) for k, s, _ in every]
        assert order == sorted(order) and x["n_random"] == sum(k == 3 for _, k in order)
    assert secrets.secret_scan(empty(spark)).isEmpty()


def test_groups_and_tokens_behind_paths_are_tested():
    r = random.Random(7)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    groups = ["-".join("".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12)) for _ in range(300)]
    behind = ["config/prod/api-" + "".join(r.choice(base62) for _ in range(32)) for _ in range(300)]
    alone = [x[16:] for x in behind]
    p = {k: [min(q for *_, q in secrets.tested(x)) for x in v] for k, v in (("groups", groups), ("behind", behind), ("alone", alone))}
    share = {k: sum(q < 1e-3 for q in v) / len(v) for k, v in p.items()}
    assert share["groups"] > 0.9 and share["behind"] > 0.97 and share["alone"] > 0.97
    assert min(q for x in ("usr-local-lib-python-site-packages-numpy", "characteristically-internationalization") for *_, q in secrets.tested(x)) > 0.1
    start, end, _, _ = secrets.tested(behind[0])[0]
    assert (start, end) == (16, 48)


def test_many_keys_in_one_text_take_linear_time():
    r = random.Random(8)
    text = "\n".join("%032x" % r.getrandbits(128) for _ in range(100_000))
    started = time.perf_counter()
    base = secrets.base_spans(text, text.encode())
    assert secrets.candidates(text, text.encode(), base) == [] and len(base) == 100_000
    assert time.perf_counter() - started < 5


def plain_url(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


def test_urls_equal_a_plain_version(spark):
    given = [
        None, "", "no scheme", "http://", "https://Example.COM/en/1?x=/net/es/#y", "http://www.example.com/en/x", "http://a.www.example.com/en/",
        "http://myexample.com/en/", "http://x.net/es/1", "http://x.net/esx", "ftp://net/fr/", "http://com", "http://com/", "a://b://c.com/d",
        "http://É.com/é\n/x", "http://casino-bets.example.org/en/1", "http://casino-bets.example.org/en/1",
    ]
    pages = spark.createDataFrame([(i, u, "html", "s") for i, u in enumerate(given)], "page_id long, url string, html string, score string")
    found = rows(urls.url_filter(pages))
    weights, bias = urls.train(urls.labelled())
    assert [r[0] for r in sorted(found)] == list(range(len(given)))
    for i, host, path, rule, verdict, score in found:
        h, p, best = plain_url(given[i])
        f = urls.features(h, p)
        chance = 1 / (1 + np.exp(-(weights[f].sum() / np.sqrt(max(len(f), 1)) + bias)))
        assert (host, path, rule) == (h, p, best and best[0]) and abs(score - chance) < 1e-8
        assert verdict == (best[1] if best else "block" if chance >= 0.5 else "allow")
    assert urls.url_filter(pages.where("page_id < 0")).isEmpty()


def test_the_url_model_ranks_unseen_hosts():
    """Four folds over the hosts of the table: a page to block is mostly ranked above one to keep."""
    table = urls.labelled()
    bare = lambda h: h.removeprefix("www.").removeprefix("m.").removeprefix("blog.")
    hosts = sorted({bare(h) for h, *_ in table})
    scores = {0: [], 1: []}
    for fold in range(4):
        held = set(hosts[fold::4])
        weights, bias = urls.train([x for x in table if bare(x[0]) not in held])
        for host, path, label in table:
            if bare(host) in held:
                f = urls.features(host, path)
                scores[label].append(weights[f].sum() / np.sqrt(len(f)) + bias)
    assert len(scores[0]) + len(scores[1]) == len(table)
    above = np.array(scores[1])[:, None] > np.array(scores[0])[None, :]
    assert above.mean() >= 0.8
    assert urls.train([])[0].sum() == 0
