"""License scan: ordered signature rules behind a keyword filter.

A rule is a regular expression with a keyword, a priority and a confidence. One pass of an
Aho-Corasick automaton over a text finds which keywords occur; only their rules run. Detections
then are resolved by priority: one whose characters lie inside a detection of better priority (or
of the same priority and longer, or equal and earlier in the table) is dropped.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemeter.llm.shared import fresh, kind, table

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORDS = re.compile(f"{WORD}+")
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: For counting words in UTF-8: A-Z lowered, every other ASCII byte that is no letter or digit a blank.
WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))

#: Phrases whose words stand consecutively, and their labels; fixed values.
PHRASES = (
    ("under the mit license", "mit", "license"),
    ("apache license version 2", "apache-2", "apache"),
    ("cc by nc", "cc-by-nc", None),
)

#: label | tags (SPDX style) | name as a pattern | keyword of the name | address as a pattern | keyword of the address
#: In a name, "_" is any run of blanks, commas, hyphens or brackets, and "V" an optional word for version.
FAMILIES = r"""
mit | mit | mit_license | mit license | opensource\.org/licenses?/mit | opensource.org/license
x11 | x11 | x11_license | x11 license | |
mit-0 | mit-0 | mit_no_attribution | no attribution | opensource\.org/licenses?/mit-0 | mit-0
expat | expat | expat_license | expat license | directory\.fsf\.org/wiki/license:expat | license:expat
apache-1 | apache-1.1,apache-1.0 | apache_(?:software_)?license_V1\.[01] | apache | apache\.org/licenses/license-1\.[01] | license-1.
apache-2 | apache-2.0 | apache_license_V2(?:\.0)? | apache | apache\.org/licenses/license-2\.0 | license-2.0
bsd-2 | bsd-2-clause,bsd-2-clause-patent | (?:2_clause_bsd|simplified_bsd|freebsd)_license | bsd | opensource\.org/licenses?/bsd-2-clause | bsd-2-clause
bsd-3 | bsd-3-clause,bsd-3-clause-clear | (?:3_clause_bsd|new_bsd|modified_bsd|revised_bsd)_license | bsd | opensource\.org/licenses?/bsd-3-clause | bsd-3-clause
bsd-4 | bsd-4-clause | (?:4_clause_bsd|original_bsd)_license | bsd | directory\.fsf\.org/wiki/license:bsd-4-clause | bsd-4-clause
bsd-0 | 0bsd | (?:0_clause_bsd|zero_clause_bsd|bsd_zero_clause)_license | bsd | opensource\.org/licenses?/0bsd | 0bsd
bsd | bsd-1-clause,bsd-source-code | bsd_(?:style_)?license | bsd | |
isc | isc | isc_license | isc license | opensource\.org/licenses?/isc | licenses/isc
gpl-1 | gpl-1.0-only,gpl-1.0-or-later | gnu_general_public_license_V1(?:\.0)? | general public | gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0 | gpl-1.0
gpl-2 | gpl-2.0,gpl-2.0-only,gpl-2.0-or-later | gnu_(?:gpl|general_public_license)_V2(?:\.0)? | gnu | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0 | gpl-2.0
gpl-3 | gpl-3.0,gpl-3.0-only,gpl-3.0-or-later | gnu_(?:gpl|general_public_license)_V3(?:\.0)? | gnu | gnu\.org/licenses/gpl-3\.0 | gpl-3.0
gpl | gpl | gnu_(?:gpl|general_public_license) | gnu | gnu\.org/(?:copyleft|licenses)/gpl\b | gnu.org
lgpl-2 | lgpl-2.0-only,lgpl-2.1,lgpl-2.1-only,lgpl-2.1-or-later | gnu_(?:lgpl|(?:lesser|library)_general_public_license)_V2(?:\.[01])? | gnu | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.[01] | lgpl-2.
lgpl-3 | lgpl-3.0,lgpl-3.0-only,lgpl-3.0-or-later | gnu_(?:lgpl|lesser_general_public_license)_V3(?:\.0)? | gnu | gnu\.org/licenses/lgpl-3\.0 | lgpl-3.0
lgpl | lgpl | gnu_(?:lgpl|(?:lesser|library)_general_public_license) | gnu | gnu\.org/licenses/lgpl\b | gnu.org
agpl-3 | agpl-3.0,agpl-3.0-only,agpl-3.0-or-later | (?:gnu_)?(?:agpl|affero_general_public_license)_V3(?:\.0)? | agpl | gnu\.org/licenses/agpl-3\.0 | agpl-3.0
agpl | agpl-1.0-only,agpl-1.0-or-later | (?:gnu_)?affero_general_public_license | affero | gnu\.org/licenses/agpl\b | gnu.org
gfdl | gfdl-1.1-or-later,gfdl-1.2-or-later,gfdl-1.3-or-later | gnu_free_documentation_license | free documentation | gnu\.org/licenses/fdl | licenses/fdl
mpl-1 | mpl-1.0,mpl-1.1 | mozilla_public_license_V1\.[01] | mozilla public | mozilla\.org/mpl/1\.[01] | mozilla.org/mpl
mpl-2 | mpl-2.0,mpl-2.0-no-copyleft-exception | mozilla_public_license_V2(?:\.0)? | mozilla public | mozilla\.org/(?:en-us/)?mpl/2\.0 | mpl/2.0
epl-1 | epl-1.0 | eclipse_public_license_V1(?:\.0)? | eclipse public | eclipse\.org/legal/epl-v10 | epl-v10
epl-2 | epl-2.0 | eclipse_public_license_V2(?:\.0)? | eclipse public | eclipse\.org/legal/epl-(?:2\.0|v20) | eclipse.org/legal
edl-1 | edl-1.0 | eclipse_distribution_license | eclipse distribution | eclipse\.org/org/documents/edl | documents/edl
cddl | cddl-1.0,cddl-1.1 | common_development_and_distribution_license | development and distribution | opensource\.org/licenses?/cddl-1 | cddl-1
cpl-1 | cpl-1.0 | common_public_license | common public | opensource\.org/licenses?/cpl1 | cpl1
cpal-1 | cpal-1.0 | common_public_attribution_license | public attribution | opensource\.org/licenses?/cpal | licenses/cpal
ipl-1 | ipl-1.0 | ibm_public_license | ibm public | opensource\.org/licenses?/ipl | licenses/ipl
eupl-1 | eupl-1.1,eupl-1.2 | european_union_public_licen[cs]e | european union public | joinup\.ec\.europa\.eu/[a-z/]*eupl | eupl
osl-3 | osl-2.1,osl-3.0 | open_software_license_V[23](?:\.[0-9])? | open software license | opensource\.org/licenses?/osl | licenses/osl
afl-3 | afl-2.1,afl-3.0 | academic_free_license | academic free | opensource\.org/licenses?/afl | licenses/afl
artistic-1 | artistic-1.0,artistic-1.0-perl | artistic_license_V1(?:\.0)? | artistic license | opensource\.org/licenses?/artistic-1 | artistic-1
artistic-2 | artistic-2.0 | artistic_license_V2(?:\.0)? | artistic license | opensource\.org/licenses?/artistic-2 | artistic-2
perl | perl | same_terms_as_perl(?:_itself)? | as perl | |
python-2 | psf-2.0,python-2.0 | python_software_foundation_license | python software foundation | docs\.python\.org/[0-9/]*license | docs.python.org
ruby | ruby | ruby_license | ruby license | ruby-lang\.org/en/about/license | ruby-lang.org
php-3 | php-3.0,php-3.01 | php_license_V3(?:\.01?)? | php license | php\.net/license/3 | php.net/license
zlib | zlib | (?:zlib|zlib_libpng)_license | zlib | zlib\.net/zlib_license | zlib_license
libpng | libpng,libpng-2.0 | (?:png_reference_library|libpng)_license | png | libpng\.org/pub/png/src/libpng-license | libpng-license
boost-1 | bsl-1.0 | boost_software_license(?:_V1(?:\.0)?)? | boost software | boost\.org/license_1_0 | license_1_0
unlicense | unlicense | (?:the_unlicense|released_into_the_public_domain) | the unlicense | unlicense\.org | unlicense.org
wtfpl | wtfpl | do_what_the_[a-z*]+_you_want_to_public_license | you want to public | wtfpl\.net | wtfpl.net
cc0 | cc0-1.0 | (?:cc0|creative_commons_zero)(?:_V?1\.0)?(?:_universal)? | cc0 | creativecommons\.org/publicdomain/zero | publicdomain/zero
cc-pd | cc-pddc | creative_commons_public_domain_(?:mark|dedication) | public domain | creativecommons\.org/publicdomain/mark | publicdomain/mark
cc-by | cc-by-2.0,cc-by-3.0,cc-by-4.0 | (?:cc_by|creative_commons_attribution)_(?:V?[1-4]\.[05]|license|international) | creative commons | creativecommons\.org/licenses/by/[0-9] | licenses/by/
cc-by-sa | cc-by-sa-2.0,cc-by-sa-3.0,cc-by-sa-4.0 | (?:cc_by_sa|creative_commons_attribution_share_?alike) | attribution | creativecommons\.org/licenses/by-sa/ | licenses/by-sa
cc-by-nd | cc-by-nd-3.0,cc-by-nd-4.0 | (?:cc_by_nd|creative_commons_attribution_no_?deriv(?:ative)?s?) | attribution | creativecommons\.org/licenses/by-nd/ | licenses/by-nd
cc-by-nc | cc-by-nc-2.0,cc-by-nc-3.0,cc-by-nc-4.0 | creative_commons_attribution_non_?commercial | attribution | creativecommons\.org/licenses/by-nc/ | licenses/by-nc/
cc-by-nc-sa | cc-by-nc-sa-3.0,cc-by-nc-sa-4.0 | (?:cc_by_nc_sa|creative_commons_attribution_non_?commercial_share_?alike) | nc | creativecommons\.org/licenses/by-nc-sa/ | licenses/by-nc-sa
cc-by-nc-nd | cc-by-nc-nd-3.0,cc-by-nc-nd-4.0 | (?:cc_by_nc_nd|creative_commons_attribution_non_?commercial_no_?deriv(?:ative)?s?) | nc | creativecommons\.org/licenses/by-nc-nd/ | licenses/by-nc-nd
odbl | odbl-1.0 | open_(?:data_commons_open_)?database_license | database license | opendatacommons\.org/licenses/odbl | licenses/odbl
odc-by | odc-by-1.0 | open_data_commons_attribution_license | data commons attribution | opendatacommons\.org/licenses/by | opendatacommons.org
pddl | pddl-1.0 | public_domain_dedication_and_licen[cs]e | dedication and | opendatacommons\.org/licenses/pddl | licenses/pddl
ofl-1 | ofl-1.0,ofl-1.1 | (?:sil_)?open_font_license | open font | scripts\.sil\.org/ofl | sil.org/ofl
ms-pl | ms-pl | microsoft_public_license | microsoft public | opensource\.org/licenses?/ms-pl | ms-pl
ms-rl | ms-rl | microsoft_reciprocal_license | microsoft reciprocal | opensource\.org/licenses?/ms-rl | ms-rl
upl-1 | upl-1.0 | universal_permissive_license | universal permissive | oss\.oracle\.com/licenses/upl | licenses/upl
ncsa | ncsa | university_of_illinois_(?:ncsa_)?open_source_license | of illinois | opensource\.org/licenses?/ncsa | licenses/ncsa
w3c | w3c,w3c-20150513 | w3c_(?:software_)?(?:notice_and_)?license | w3c | w3\.org/consortium/legal/[0-9/]*copyright-software | copyright-software
curl | curl | curl_license | curl license | curl\.se/docs/copyright | curl.se/docs
openssl | openssl | openssl_license | openssl license | openssl\.org/source/license | openssl.org/source
postgresql | postgresql | postgresql_licen[cs]e | postgresql licen | postgresql\.org/about/licen[cs]e | about/licen
sleepycat | sleepycat | sleepycat_license | sleepycat | |
vim | vim | vim_license | vim license | vimdoc\.sourceforge\.net/htmldoc/uganda | uganda
lppl | lppl-1.0,lppl-1.2,lppl-1.3c | latex_project_public_license | latex project | latex-project\.org/lppl | lppl
qpl-1 | qpl-1.0 | q_public_license | q public license | opensource\.org/licenses?/qtpl | licenses/qtpl
nasa-1 | nasa-1.3 | nasa_open_source_agreement | nasa open | |
cecill-2 | cecill-2.0,cecill-2.1,cecill-b,cecill-c | cecill(?:_[bc])?_(?:free_software_)?license | cecill | cecill\.info/licences | cecill.info
mulan-2 | mulanpsl-2.0 | mulan_permissive_software_license | mulan permissive | license\.coscl\.org\.cn | coscl.org
sspl-1 | sspl-1.0 | server_side_public_license | server side public | mongodb\.com/licensing/server-side-public-license | server-side-public
busl-1 | busl-1.1 | business_source_license | business source | mariadb\.com/bsl | mariadb.com/bsl
elastic-2 | elastic-2.0 | elastic_license_V2(?:\.0)? | elastic license | elastic\.co/licensing/elastic-license | elastic-license
polyform | polyform-noncommercial-1.0.0,polyform-small-business-1.0.0 | polyform_(?:non_?commercial|small_business)_license | polyform | polyformproject\.org/licenses | polyformproject.org
openrail | openrail | (?:creativeml_)?(?:bigscience_)?open_?rail(?:_m)?_license | rail | |
public-domain | public-domain | (?:placed|dedicated)_(?:in|to)_the_public_domain | the public domain | |
proprietary | proprietary,licenseref-proprietary | all_rights_reserved | all rights reserved | |
"""


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    pattern: str
    keyword: str
    priority: int
    confidence: float


NOTICE = (
    r"(?:licen[sc]ed|released|distributed|available|provided|published|redistributed)\s+(?:to\s+you\s+)?under\s+"
    r"(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+(?:the\s+)?)?"
)


def rules() -> list[Rule]:
    """The table in order: tags first, then notices, addresses and bare names."""
    found: dict[int, list[Rule]] = {1: [], 2: [], 3: [], 4: []}
    for line in FAMILIES.strip().splitlines():
        label, tags, name, keyword, address, address_keyword = _cells(line)
        name = name.replace("V", r"(?:v(?:ersion)?\.?[\s,-]*)?").replace("_", r"[\s,()-]*")
        for tag in tags.split(","):
            found[1].append(Rule(f"tag:{tag}", label, rf"spdx-license-identifier:[\s(]*{re.escape(tag)}(?![\w.+-]*\w)", tag, 1, 0.99))
        found[2].append(Rule(f"notice:{label}:{keyword}", label, rf"{NOTICE}{name}(?!\w)", keyword, 2, 0.95))
        if address:
            found[3].append(Rule(f"address:{label}", label, rf"(?<![\w.])(?:https?://)?(?:www\.)?{address}", address_keyword, 3, 0.9))
        found[4].append(Rule(f"name:{label}:{keyword}", label, rf"(?<!\w){name}(?!\w)", keyword, 4, 0.7))
    return [r for k in sorted(found) for r in found[k]]


def _cells(line: str) -> list[str]:
    """Six cells; trailing ones may be missing, and a bar inside brackets is part of a pattern."""
    cells = re.split(r"(?<=\s)\|(?=\s|$)", line.strip())
    return [c.strip() for c in cells] + [""] * (6 - len(cells))


def phrase_pattern(phrase: str) -> str:
    first, *rest = phrase.split(" ")
    return f"{first}(?<!{WORD}{first})" + "".join(GAP + w for w in rest) + f"(?!{WORD})"


def resolve(found: list[tuple]) -> list[tuple]:
    """Drop detections that lie inside a better one. An item is (start, end, priority, order, ...).

    Priorities are taken in turn. What is kept so far is held by start with the farthest end up to
    it, so one search tells whether an item lies inside; base phrases (priority 0) always stay.
    """
    kept: list[tuple] = []
    for priority in sorted({x[2] for x in found}):
        better = sorted((x[0], x[1]) for x in kept)
        starts, reach = [s for s, _ in better], list(accumulate((e for _, e in better), max))
        far = -1
        for item in sorted((x for x in found if x[2] == priority), key=lambda x: (x[0], -x[1], x[3])):
            start, end = item[:2]
            i = bisect_right(starts, start)
            if priority and (far >= end or i and reach[i - 1] >= end):
                continue
            kept.append(item)
            far = max(far, end)
    return sorted(kept, key=lambda x: (x[0], -x[1], x[2], x[3]))


def lowered(text: str) -> str:
    """A-Z lowered and nothing else, so positions stay. Done on UTF-8, which is faster."""
    return text.encode().translate(LOWER_BYTES).decode()


class Scanner:
    """The compiled rules; built once per task."""

    def __init__(self) -> None:
        self.rules = [(re.compile(r.pattern), r) for r in rules()]
        self.phrases = [(re.compile(phrase_pattern(p)), label, k) for p, label, k in PHRASES]
        gates: dict[str, list[int]] = {}
        for i, (_, r) in enumerate(self.rules):
            gates.setdefault(r.keyword, []).append(i)
        for i, (_, _, k) in enumerate(self.phrases):
            if k:
                gates.setdefault(k, []).append(-1 - i)
        self.always = [-1 - i for i, (_, _, k) in enumerate(self.phrases) if not k]
        self.automaton = ahocorasick.Automaton()
        for keyword, ids in gates.items():
            self.automaton.add_word(keyword, ids)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[dict]]:
        words = len(text.encode().translate(WORD_BYTES).split())
        low = lowered(text)
        gated: list[int] = list(self.always)
        seen = set()
        for _, ids in self.automaton.iter(low):
            if id(ids) not in seen:
                seen.add(id(ids))
                gated += ids
        found = []
        for i in sorted(gated):
            if i < 0:
                pattern, label, _ = self.phrases[-1 - i]
                found += [(m.start(), m.end(), 0, i, f"phrase:{label}", label, 1.0) for m in pattern.finditer(low)]
            else:
                pattern, r = self.rules[i]
                found += [(m.start(), m.end(), r.priority, i, r.name, r.label, r.confidence) for m in pattern.finditer(low)]
        kept = resolve(found)
        starts = [m.start() for m in WORDS.finditer(low)] if kept else []
        return words, [
            {"rule": name, "label": label, "base": priority == 0, "start": start, "end": end, "word": bisect_left(starts, start), "confidence": confidence}
            for start, end, priority, _, name, label, confidence in kept
        ]


@functools.cache
def scanner() -> Scanner:
    """One for all tasks of a Python worker."""
    return Scanner()


DETECTION = "struct<rule:string,label:string,base:boolean,start:bigint,end:bigint,word:bigint,confidence:double>"


def license_scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the kept columns, `n_words` and `detections` by position.

    A null or empty text has no words and no detections. Repeated rows are scanned one by one.
    Other columns are not read. Nothing moves between tasks, and a task holds one batch of texts.
    """
    (body,) = fresh(keep, "body")
    words, hits = fresh([*keep, body], "n_words", "detections")
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(body))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner().scan(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], HITS)],
                names=[*keep, words, hits],
            )

    schema = ", ".join([*(f"`{c}` {kind(docs, c)}" for c in keep), f"`{words}` bigint", f"`{hits}` array<{DETECTION}>"])
    return rows.mapInArrow(scan, schema)


HITS = pa.list_(pa.struct([
    ("rule", pa.string()), ("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()),
    ("word", pa.int64()), ("confidence", pa.float64()),
]))


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """Word count, places of the base phrases, all labels, and the chance that any detection is right."""
    scanned = license_scan(table(spark, sf_dir, "documents"))
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda d: d["label"]))), ",")
    base = F.filter("detections", lambda d: d["base"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["word"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"),
        F.round(1 - F.aggregate("detections", F.lit(1.0), lambda a, d: a * (1 - d["confidence"] * 0.99)), 6).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
