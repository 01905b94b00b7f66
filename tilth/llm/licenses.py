"""License scan of whole texts, in DataFrame functions only.

A text's words are its maximal runs of ASCII letters and digits and of any other non-ASCII
characters. Texts without any word that some rule requires go no further. In the others the words, lower-cased and
joined by single spaces, are searched by the signature rules whose required words are all there; a
rule is a regular expression over whole words with a label, a priority and a weight. A detection is
suppressed if it lies within one of at least its priority; what is left gives the labels.
Everything happens within the row: no shuffle.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.llm.minhash import let

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
# Names of licenses as they read in lower-cased words: label, words that must be there, expression.
FAMILIES: tuple[tuple[str, str, str], ...] = (
    ("apache-1.1", "apache", r"(?:the )?apache (?:software )?(?:licen[sc]e )?(?:version |v)?1 1"),
    ("apache-2.0", "apache", r"(?:the )?apache (?:software )?(?:licen[sc]e )?(?:version |v)?2(?: 0)?(?: licen[sc]e)?"),
    ("apache", "apache", r"(?:the )?apache (?:software )?licen[sc]e"),
    ("mit", "mit", r"(?:the )?mit(?: x11| expat)? licen[sc]e"),
    ("mit", "expat", r"(?:the )?expat licen[sc]e"),
    ("mit-0", "attribution", r"mit no attribution"),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:simplified |freebsd |2 clause |two clause )bsd(?: licen[sc]e)?|bsd 2 clause(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:new |modified |revised |3 clause |three clause )bsd(?: licen[sc]e)?|bsd 3 clause(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:the )?(?:original |old |4 clause |four clause )bsd(?: licen[sc]e)?|bsd 4 clause(?: licen[sc]e)?"),
    ("0bsd", "0bsd", r"0bsd(?: licen[sc]e)?"),
    ("bsd", "bsd", r"(?:the |a )?bsd(?: style)? licen[sc]e"),
    ("gpl-1.0", "general", r"(?:the )?(?:gnu )?general public licen[sc]e (?:version |v)1(?: 0)?"),
    ("gpl-2.0", "general", r"(?:the )?(?:gnu )?general public licen[sc]e (?:version |v)2(?: 0)?"),
    ("gpl-3.0", "general", r"(?:the )?(?:gnu )?general public licen[sc]e (?:version |v)3(?: 0)?"),
    ("gpl", "general", r"(?:the )?(?:gnu )?general public licen[sc]e"),
    ("gpl-2.0", "gpl", r"(?:the )?(?:gnu )?gpl (?:version |v)?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:the )?(?:gnu )?gpl (?:version |v)?3(?: 0)?"),
    ("gpl-2.0", "gplv2", r"(?:the )?(?:gnu )?gplv2"),
    ("gpl-3.0", "gplv3", r"(?:the )?(?:gnu )?gplv3"),
    ("gpl", "gpl", r"(?:the )?gnu gpl|gpl licen[sc]e"),
    ("lgpl-2.0", "library", r"(?:the )?(?:gnu )?library general public licen[sc]e(?: (?:version |v)2(?: 0)?)?"),
    ("lgpl-2.1", "lesser", r"(?:the )?(?:gnu )?lesser general public licen[sc]e (?:version |v)2 1"),
    ("lgpl-3.0", "lesser", r"(?:the )?(?:gnu )?lesser general public licen[sc]e (?:version |v)3(?: 0)?"),
    ("lgpl", "lesser", r"(?:the )?(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl-2.1", "lgpl", r"(?:the )?(?:gnu )?lgpl (?:version |v)?2 1"),
    ("lgpl-3.0", "lgpl", r"(?:the )?(?:gnu )?lgpl (?:version |v)?3(?: 0)?"),
    ("lgpl", "lgpl", r"(?:the )?gnu lgpl|lgpl licen[sc]e"),
    ("agpl-3.0", "affero", r"(?:the )?(?:gnu )?affero general public licen[sc]e(?: (?:version |v)3(?: 0)?)?"),
    ("agpl-3.0", "agpl", r"(?:the )?(?:gnu )?agpl(?: (?:version |v)?3(?: 0)?)?(?: licen[sc]e)?"),
    ("agpl-3.0", "agplv3", r"(?:the )?(?:gnu )?agplv3"),
    ("gfdl-1.3", "documentation", r"(?:the )?(?:gnu )?free documentation licen[sc]e(?: (?:version |v)1 [123])?"),
    ("mpl-1.1", "mozilla", r"(?:the )?mozilla public licen[sc]e (?:version |v)?1 1"),
    ("mpl-2.0", "mozilla", r"(?:the )?mozilla public licen[sc]e (?:version |v)?2(?: 0)?"),
    ("mpl", "mozilla", r"(?:the )?mozilla public licen[sc]e"),
    ("epl-1.0", "eclipse", r"(?:the )?eclipse public licen[sc]e (?:version |v)?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"(?:the )?eclipse public licen[sc]e (?:version |v)?2(?: 0)?"),
    ("epl", "eclipse", r"(?:the )?eclipse public licen[sc]e"),
    ("cddl-1.0", "cddl", r"cddl(?: (?:version |v)?1 [01])?(?: licen[sc]e)?"),
    ("cddl-1.0", "distribution", r"(?:the )?common development and distribution licen[sc]e(?: (?:version |v)?1 [01])?"),
    ("cpl-1.0", "common", r"(?:the )?common public licen[sc]e(?: (?:version |v)?1 0)?"),
    ("eupl-1.2", "eupl", r"eupl(?: (?:version |v)?1 [12])?"),
    ("eupl-1.2", "european", r"(?:the )?european union public licen[sc]e(?: (?:version |v)?1 [12])?"),
    ("isc", "isc", r"(?:the )?isc licen[sc]e"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"(?:the )?libpng licen[sc]e(?: (?:version |v)?2)?"),
    ("bsl-1.0", "boost", r"(?:the )?boost software licen[sc]e(?: (?:version |v)?1 0)?"),
    ("busl-1.1", "business", r"(?:the )?business source licen[sc]e(?: (?:version |v)?1 1)?"),
    ("sspl-1.0", "sspl", r"sspl(?: licen[sc]e)?"),
    ("sspl-1.0", "server", r"(?:the )?server side public licen[sc]e(?: (?:version |v)?1)?"),
    ("elastic-2.0", "elastic", r"(?:the )?elastic licen[sc]e(?: (?:version |v)?2 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl(?: licen[sc]e)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "zero", r"creative commons zero(?: (?:v)?1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4](?: [05])?)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4](?: [05])?)?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4](?: [05])?)?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4](?: [05])?)?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4](?: [05])?)?"),
    ("cc-by", "cc", r"cc by(?: [1-4](?: [05])?)?"),
    ("cc-by-nc-nd", "noderivatives", r"creative commons attribution noncommercial noderivatives(?: [1-4] [05])?(?: international)?"),
    ("cc-by-nc-sa", "sharealike", r"creative commons attribution noncommercial sharealike(?: [1-4] [05])?(?: international)?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international)?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] [05])?(?: international)?"),
    ("cc", "creative", r"(?:a )?creative commons licen[sc]e"),
    ("odbl-1.0", "database", r"(?:the )?open (?:data commons open )?database licen[sc]e"),
    ("odc-by-1.0", "commons", r"open data commons attribution licen[sc]e"),
    ("pddl-1.0", "dedication", r"public domain dedication and licen[sc]e"),
    ("ofl-1.1", "ofl", r"(?:the )?(?:sil )?ofl(?: 1 1)?"),
    ("ofl-1.1", "font", r"(?:the )?(?:sil )?open font licen[sc]e(?: (?:version |v)?1 1)?"),
    ("artistic-1.0", "artistic", r"(?:the )?artistic licen[sc]e (?:version |v)?1(?: 0)?"),
    ("artistic-2.0", "artistic", r"(?:the )?artistic licen[sc]e(?: (?:version |v)?2(?: 0)?)?"),
    ("psf-2.0", "python", r"(?:the )?python software foundation licen[sc]e(?: (?:version |v)?2)?"),
    ("php-3.01", "php", r"(?:the )?php licen[sc]e(?: (?:version |v)?3 01)?"),
    ("ruby", "ruby", r"(?:the )?ruby licen[sc]e"),
    ("postgresql", "postgresql", r"(?:the )?postgresql licen[sc]e"),
    ("openssl", "openssl", r"(?:the )?openssl licen[sc]e"),
    ("ms-pl", "microsoft", r"(?:the )?microsoft public licen[sc]e"),
    ("ms-rl", "reciprocal", r"(?:the )?microsoft reciprocal licen[sc]e"),
    ("ncsa", "ncsa", r"(?:the )?(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("afl-3.0", "academic", r"(?:the )?academic free licen[sc]e(?: (?:version |v)?3 0)?"),
    ("osl-3.0", "open", r"(?:the )?open software licen[sc]e(?: (?:version |v)?3 0)?"),
    ("upl-1.0", "universal", r"(?:the )?universal permissive licen[sc]e"),
    ("ecl-2.0", "educational", r"(?:the )?educational community licen[sc]e(?: (?:version |v)?2 0)?"),
    ("mulanpsl-2.0", "mulan", r"(?:the )?mulan (?:permissive software licen[sc]e|psl)(?: v2)?"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?"),
)

# Ways a text grants a license: name of the way, required words, expression before the name, priority, weight.
GRANTS: tuple[tuple[str, tuple[str, ...], str, int, float], ...] = (
    ("named", (), "", 1, 0.6),
    ("licensed", ("licensed", "under"), r"(?:is |are )?licensed under (?:the terms of |a )?", 3, 0.95),
    ("released", ("released", "under"), r"(?:is |are )?released under (?:the terms of |a )?", 3, 0.95),
    ("distributed", ("distributed", "under"), r"(?:is |are )?distributed under (?:the terms of |a )?", 3, 0.9),
    ("available", ("available", "under"), r"(?:is |are |made )?available under (?:the terms of |a )?", 2, 0.85),
    ("identified", ("spdx",), r"spdx licen[sc]e identifier ", 2, 0.95),
    ("published", ("published", "under"), r"(?:is |are )?published under (?:the terms of |a )?", 2, 0.85),
)

# Rules that stand alone: label, required words, expression, priority, weight.
PLAIN: tuple[tuple[str, tuple[str, ...], str, int, float], ...] = (
    ("reserved", ("rights", "reserved"), r"(?:all|some) rights reserved", 2, 0.7),
    ("reserved", ("copyright", "reserved"), r"copyright (?:c )?(?:[0-9]{4} )+(?:[^ ]+ ){1,6}all rights reserved", 3, 0.8),
    ("copyright", ("copyright",), r"copyright (?:c )?[0-9]{4}(?: [0-9]{4})?", 1, 0.5),
    ("public-domain", ("public", "domain"), r"(?:released|placed|dedicated|in)(?: in)?(?: to| into)? the public domain", 2, 0.8),
    ("no-warranty", ("warranty",), r"without (?:any )?warranty(?: of any kind)?", 1, 0.5),
    ("no-warranty", ("warranties",), r"without warranties or conditions of any kind", 1, 0.6),
    ("permission", ("permission", "granted"), r"permission is hereby granted free of charge", 2, 0.8),
    ("redistribution", ("redistribution",), r"redistribution and use in source and binary forms", 2, 0.8),
    ("proprietary", ("proprietary",), r"proprietary (?:and confidential|licen[sc]e)", 2, 0.7),
    ("spdx", ("spdx",), r"spdx licen[sc]e identifier(?: [a-z0-9]+){1,4}", 1, 0.6),
    ("mit", ("sublicense",), r"to use copy modify merge publish distribute sublicense and or sell copies", 2, 0.9),
    ("mit", ("noninfringement",), r"warranties of merchantability fitness for a particular purpose and noninfringement", 1, 0.6),
    ("mit-0", ("sublicense",), r"to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit", 2, 0.5),
    ("isc", ("permission", "granted"), r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", 2, 0.9),
    ("bsd", ("redistributions",), r"redistributions of source code must retain the above copyright notice", 2, 0.85),
    ("bsd", ("redistributions",), r"redistributions in binary form must reproduce the above copyright notice", 2, 0.85),
    ("bsd-3-clause", ("endorse",), r"may be used to endorse or promote products derived from this software without specific prior written permission", 2, 0.9),
    ("bsd-4-clause", ("advertising",), r"all advertising materials mentioning features or use of this software must display", 2, 0.9),
    ("apache-2.0", ("compliance",), r"you may not use this file except in compliance with the licen[sc]e", 2, 0.85),
    ("apache-2.0", ("apache",), r"apache org licenses licen[sc]e 2 0", 3, 0.95),
    ("gpl", ("redistribute",), r"this program is free software you can redistribute it and or modify it under the terms", 2, 0.85),
    ("gpl", ("gnu",), r"you should have received a copy of the gnu general public licen[sc]e", 2, 0.9),
    ("gpl", ("gnu",), r"gnu org licenses(?: gpl)?", 1, 0.6),
    ("lgpl", ("gnu",), r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", 3, 0.9),
    ("lgpl", ("redistribute",), r"this library is free software you can redistribute it and or modify it under the terms", 2, 0.85),
    ("agpl-3.0", ("affero",), r"you should have received a copy of the gnu affero general public licen[sc]e", 3, 0.9),
    ("no-warranty", ("merchantability",), r"(?:without even the )?implied warranty of merchantability", 1, 0.5),
    ("no-warranty", ("warranty",), r"provided as is without (?:express or implied )?warranty", 1, 0.6),
    ("mpl-2.0", ("mozilla",), r"subject to the terms of the mozilla public licen[sc]e", 3, 0.9),
    ("mpl-2.0", ("mozilla",), r"mozilla org mpl 2 0", 3, 0.95),
    ("epl-2.0", ("eclipse",), r"eclipse org legal epl 2 0", 3, 0.95),
    ("epl-1.0", ("eclipse",), r"eclipse org legal epl v10", 3, 0.95),
    ("zlib", ("misrepresented",), r"the origin of this software must not be misrepresented", 2, 0.9),
    ("zlib", ("altered",), r"altered source versions must be plainly marked as such", 2, 0.85),
    ("unlicense", ("unencumbered",), r"this is free and unencumbered software released into the public domain", 3, 0.95),
    ("unlicense", ("unlicense",), r"unlicense org", 2, 0.8),
    ("wtfpl", ("fuck",), r"do what the fuck you want to public licen[sc]e", 3, 0.95),
    ("bsl-1.0", ("boost",), r"boost org licen[sc]e 1 0 txt", 3, 0.95),
    ("cc-by", ("creativecommons",), r"creativecommons org licenses by [1-4] [05]", 3, 0.95),
    ("cc-by-sa", ("creativecommons",), r"creativecommons org licenses by sa [1-4] [05]", 3, 0.95),
    ("cc-by-nc", ("creativecommons",), r"creativecommons org licenses by nc [1-4] [05]", 3, 0.95),
    ("cc-by-nd", ("creativecommons",), r"creativecommons org licenses by nd [1-4] [05]", 3, 0.95),
    ("cc-by-nc-sa", ("creativecommons",), r"creativecommons org licenses by nc sa [1-4] [05]", 3, 0.95),
    ("cc-by-nc-nd", ("creativecommons",), r"creativecommons org licenses by nc nd [1-4] [05]", 3, 0.95),
    ("cc0-1.0", ("creativecommons",), r"creativecommons org publicdomain zero 1 0", 3, 0.95),
    ("public-domain", ("creativecommons",), r"creativecommons org publicdomain mark 1 0", 3, 0.9),
    ("cc0-1.0", ("waived",), r"(?:has )?waived all copyright and related or neighboring rights", 2, 0.9),
    ("ofl-1.1", ("ofl",), r"scripts sil org ofl", 3, 0.95),
    ("artistic-2.0", ("perl",), r"same terms as perl(?: itself)?", 1, 0.6),
    ("proprietary", ("unauthorized",), r"unauthorized (?:copying|reproduction|use|distribution)(?: or distribution)? of this (?:file|software|work|document)", 2, 0.7),
    ("proprietary", ("reproduced",), r"may not be reproduced(?: distributed)?(?: or transmitted)? in any form", 2, 0.7),
    ("proprietary", ("confidential",), r"trade secret(?:s)? and confidential", 1, 0.6),
    ("non-commercial", ("noncommercial",), r"for noncommercial (?:use|purposes) only", 2, 0.7),
    ("non-commercial", ("commercial",), r"for non commercial (?:use|purposes) only", 2, 0.7),
    ("non-commercial", ("commercial",), r"not for commercial use", 2, 0.6),
    ("research-only", ("research",), r"for research (?:use|purposes) only", 2, 0.7),
    ("no-derivatives", ("derivative",), r"no derivative works", 1, 0.6),
    ("share-alike", ("sharealike",), r"sharealike [1-4] [05]", 1, 0.6),
)

# Identifiers of the SPDX list: each is a rule of its own behind "SPDX-License-Identifier:".
IDENTIFIERS = """
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause
BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0
CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0
CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CPL-1.0 ECL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2
GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU ISC JSON LGPL-2.0
LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later Libpng MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL
MulanPSL-2.0 NCSA ODbL-1.0 ODC-By-1.0 OFL-1.1 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby SSPL-1.0
Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
""".split()


def rules() -> list[dict]:
    """The signature rules: every way of granting every family, the plain ones, and the identifiers."""
    found = [
        {"label": label, "need": [word, *need], "regex": f" {before}(?:{name})(?= )", "priority": priority, "weight": weight}
        for label, word, name in FAMILIES
        for _, need, before, priority, weight in GRANTS
    ]
    found += [{"label": l, "need": list(n), "regex": f" (?:{x})(?= )", "priority": p, "weight": w} for l, n, x, p, w in PLAIN]
    for name in IDENTIFIERS:
        words = re.findall("[a-z0-9]+", name.lower())
        label = re.sub("-(only|or-later)$", "", name.lower())
        found.append({"label": label, "need": ["spdx", words[0]], "regex": f" spdx licen[sc]e identifier {' '.join(words)}(?= )", "priority": 3, "weight": 0.95})
    return found


def stems() -> list[str]:
    """A substring that each rule and base phrase requires: "licen" where its expression can't do without, or else its longest required word."""

    def of(need: tuple[str, ...], regex: str) -> str:
        bare = re.sub(r"\(\?:[^()]*\)\?", "", regex)  # without what is optional
        return "licen" if all("licen[sc]e" in way for way in bare.split("|")) else max(need, key=len)

    every = {of((word,), name) for _, word, name in FAMILIES} | {of(need, regex) for _, need, regex, *_ in PLAIN} | {max(phrase.split(), key=len) for phrase, _ in BASE}
    return sorted(w for w in every if not any(x != w and x in w for x in every))


LEVELS = 3
RULE = "struct<label: string, need: array<string>, regex: string, priority: int, weight: double>"


def spaces(s: Column) -> Column:
    return F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))


def occurrences(norm: Column, rule: Column) -> Column:
    """Where a rule's expression stands: array of (start, end, rank, label, weight), in words."""

    def fold(pieces: Column, hits: Column) -> Column:
        none = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start: int, end: int, priority: int, label: string, weight: double>>))")

        def step(acc: Column, pair: Column) -> Column:
            start = acc["at"] + spaces(pair["piece"])
            end = start + spaces(pair["hit"])
            span = F.named_struct(F.lit("start"), start, F.lit("end"), end, F.lit("priority"), rule["priority"], F.lit("label"), rule["label"], F.lit("weight"), rule["weight"])
            return F.named_struct(F.lit("at"), end, F.lit("spans"), F.concat(acc["spans"], F.array(span)))

        pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.named_struct(F.lit("piece"), p, F.lit("hit"), h))
        return F.aggregate(pairs, none, step)["spans"]

    hits = F.regexp_extract_all(norm, rule["regex"], F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) > 0, let(F.split(norm, rule["regex"]), lambda p: fold(p, h))).otherwise(F.expr("cast(array() as array<struct<start: int, end: int, priority: int, label: string, weight: double>>)")))


def detections(norm: Column) -> Column:
    """Detections of all rules in joined words, suppressed ones removed, by start."""
    table = F.from_json(F.lit(json.dumps(rules())), f"array<{RULE}>")
    words = sorted({w for r in rules() for w in r["need"]})
    present = F.array_intersect(F.split(F.trim(norm), " "), F.array(*map(F.lit, words)))

    def search(there: Column) -> Column:
        active = F.filter(table, lambda r: F.forall(r["need"], lambda w: F.array_contains(there, w)))
        return F.flatten(F.transform(active, lambda r: occurrences(norm, r)))

    def suppress(spans: Column) -> Column:
        # by start, longer first, then by priority: whatever contains a span comes before it
        keyed = F.transform(
            spans,
            lambda s: F.named_struct(
                F.lit("start"), s["start"], F.lit("back"), -s["end"], F.lit("rank"), -s["priority"], F.lit("label"), s["label"],
                F.lit("end"), s["end"], F.lit("priority"), s["priority"], F.lit("weight"), s["weight"],
            ),
        )
        zero = F.expr(
            "named_struct('reach', array(0, 0, 0), 'kept', "
            "cast(array() as array<struct<start: int, back: int, rank: int, label: string, end: int, priority: int, weight: double>>))"
        )

        def step(acc: Column, s: Column) -> Column:
            inside = F.element_at(acc["reach"], s["priority"]) >= s["end"]
            reach = F.transform(acc["reach"], lambda m, i: F.when(i < s["priority"], F.greatest(m, s["end"])).otherwise(m))
            return F.named_struct(F.lit("reach"), reach, F.lit("kept"), F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(s))))

        return F.aggregate(F.sort_array(keyed), zero, step)["kept"]

    return suppress(let(present, search))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_words, n_base, first_word, last_word, base_labels, detections, labels, score.

    Null text is empty: no words, no labels, score 0. ``detections`` are (start, end, priority,
    label, weight) in words, what containment left of the rules; ``score`` is one less the product
    of what each leaves of doubt. Every row gets a row, repeated and null doc_ids too; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.translate(text, upper, lower)
    gate = F.lit(False)
    for stem in stems():
        gate = gate | F.contains(low, F.lit(stem))
    joined = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, NOT_WORD, " ")), F.lit(" "))
    rows = docs.select("doc_id", F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("n_words"), F.when(gate, joined).alias("norm"))

    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        sought = f" {phrase} "
        there = F.contains("norm", F.lit(sought))
        size = len(phrase.split())
        counts.append(F.when(there, F.regexp_count("norm", F.lit(f" {phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(there, spaces(F.substring_index("norm", sought, 1))))
        lasts.append(F.when(there, F.col("n_words") - size - spaces(F.substring_index("norm", sought, -1))))
        labels.append(F.when(there, F.lit(label)))
    base = rows.select(
        "doc_id", "n_words", "norm",
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base_found"),
        F.when(F.col("norm").isNotNull(), detections(F.col("norm"))).alias("found"),
    )
    spans = F.coalesce("found", F.expr("cast(array() as array<struct<start: int, back: int, rank: int, label: string, end: int, priority: int, weight: double>>)"))
    doubt = F.aggregate(spans, F.lit(1.0), lambda acc, s: acc * (1 - s["weight"]))
    doubt = doubt * F.when(F.size("base_found") > 0, 0.5).otherwise(1.0)
    return base.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array(F.array_distinct("base_found")), ",").alias("base_labels"),
        F.transform(spans, lambda s: F.named_struct(*[x for f in ("start", "end", "priority", "label", "weight") for x in (F.lit(f), s[f])])).alias("detections"),
        F.array_join(F.sort_array(F.array_distinct(F.concat("base_found", F.transform(spans, lambda s: s["label"])))), ",").alias("labels"),
        (1 - doubt).alias("score"),
    )
