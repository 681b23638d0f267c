"""Licences of observation texts by sentence rules.

A text is normalised and split into sentences; each sentence that is known stands for an identifier,
possibly with the version it names. The identifiers of a text, in order, are matched against ordered
rules: the first rule that finds its sequence takes those identifiers, later rules see what is left.
The project's sources have a licence name each; their texts are observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.llm.common import fields

#: Normalised sentences and their identifiers. <v> stands for a version.
SENTENCES = {
    "released under the mit license": "MITref",
    "this software is released under the mit license": "MITref",
    "licensed under the mit license": "MITref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MITperm",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is without warranty of any kind": "MITwarr",
    "licensed under the apache license version <v>": "Apacheref-<v>",
    "you may not use this file except in compliance with the license": "ApacheCompl",
    "you may obtain a copy of the license at http www apache org licenses license <v>": "ApacheURL-<v>",
    "this work is licensed under the gnu general public license version <v>": "GPLref-<v>",
    "licensed under the gnu general public license version <v>": "GPLref-<v>",
    "this program is free software": "FreeSoft",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPLredist",
    "either version <v> of the license or at your option any later version": "AnyLater-<v>",
    "licensed under cc by <v>": "CCref-BY-<v>",
    "licensed under cc by sa <v>": "CCref-BY-SA-<v>",
    "licensed under cc by nc <v>": "CCref-BY-NC-<v>",
    "licensed under cc by nc sa <v>": "CCref-BY-NC-SA-<v>",
    "licensed under cc by nd <v>": "CCref-BY-ND-<v>",
    "licensed under cc0 <v>": "CCref-0-<v>",
    "released under the bsd license": "BSDref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDredist",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsrc",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbin",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "this work is in the public domain": "PublicDomain",
    "all rights reserved": "AllRights",
}
V = "([0-9][0-9.]*)"
#: Ordered rules, the sequence of identifiers and the licence; {v} is the first version in it.
RULES = [
    (["MITperm", "MITnotice", "MITwarr"], "MIT"),
    (["MITperm", "MITnotice"], "MIT"),
    ([f"Apacheref-{V}", "ApacheCompl", "ApacheURL-[0-9.]+"], "Apache-{v}"),
    ([f"Apacheref-{V}", "ApacheCompl"], "Apache-{v}"),
    (["FreeSoft", "GPLredist", f"AnyLater-{V}"], "GPL-{v}-or-later"),
    (["BSDredist", "BSDsrc", "BSDbin", "BSDendorse"], "BSD-3-Clause"),
    (["BSDredist", "BSDsrc", "BSDbin"], "BSD-2-Clause"),
    (["BSDredist", "BSDsrc"], "BSD-1-Clause"),
    ([f"CCref-((?:BY|0)[A-Z-]*-)([0-9][0-9.]*)"], "CC-{cc}"),
    ([f"Apacheref-{V}"], "Apache-{v}"),
    ([f"GPLref-{V}"], "GPL-{v}-only"),
    (["MITref"], "MIT"),
    (["BSDref"], "BSD"),
    (["PublicDomain"], "Public-Domain"),
]
#: Sentences of the licences' own notices that go on where the short forms above stop, and their rules.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITperm",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITwarr",
    "licensed under the apache license version <v> the license": "Apacheref-<v>",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <v> of the license or at your option any later version": "GPLlater-<v>",
    "you can redistribute it and or modify it under the terms of the gnu general public license version <v> as published by the free software foundation": "GPLonly-<v>",
}
NOTICE_RULES = [(["FreeSoft", f"GPLlater-{V}"], "GPL-{v}-or-later"), (["FreeSoft", f"GPLonly-{V}"], "GPL-{v}-only")]
#: Further licences by name, their notices, and the names that an SPDX line may give.
GNU = {"gnu lesser general public license": "LGPL", "gnu library general public license": "LGPL", "gnu affero general public license": "AGPL"}
CREATIVE = {"attribution": "BY", "attribution sharealike": "BY-SA", "attribution noncommercial": "BY-NC", "attribution noncommercial sharealike": "BY-NC-SA",
            "attribution noderivatives": "BY-ND", "attribution noncommercial noderivatives": "BY-NC-ND"}
OTHERS = {
    "this library is free software": "FreeSoft",
    "this source code form is subject to the terms of the mozilla public license v <v>": "MPLref-<v>",
    "licensed under the mozilla public license <v>": "MPLref-<v>",
    "licensed under the mozilla public license version <v>": "MPLref-<v>",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl <v>": "MPLURL-<v>",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl <v>": "MPLURL-<v>",
    "this program and the accompanying materials are made available under the terms of the eclipse public license <v>": "EPLref-<v>",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v <v>": "EPLref-<v>",
    "licensed under the eclipse public license <v>": "EPLref-<v>",
    "licensed under the eclipse public license version <v>": "EPLref-<v>",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCperm",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCperm",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "ZeroBSDperm",
    "licensed under the isc license": "ISCref",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "Zlibperm",
    "distributed under the boost software license version <v>": "BSLref-<v>",
    "licensed under the boost software license version <v>": "BSLref-<v>",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "licensed under the bsd license": "BSDref",
}
SPDX = {"mit": "MIT", "isc": "ISC", "zlib": "Zlib", "unlicense": "Unlicense", "0bsd": "0BSD", "apache <v>": "Apache-<v>", "mpl <v>": "MPL-<v>", "epl <v>": "EPL-<v>", "bsl <v>": "BSL-<v>",
        "bsd <v> clause": "BSD-<v>-Clause", "cc0 <v>": "CC0-<v>"}
OTHER_RULES = [(["MPLref-" + V, "MPLURL-[0-9.]+"], "MPL-{v}"), (["MPLref-" + V], "MPL-{v}"), (["EPLref-" + V], "EPL-{v}"), (["ISCperm"], "ISC"), (["ISCref"], "ISC"), (["ZeroBSDperm"], "0BSD"),
               (["Zlibperm"], "Zlib"), (["BSLref-" + V], "BSL-{v}"), (["Unlicense"], "Unlicense"), (["SPDX-([A-Za-z0-9.-]+)"], "{v}")]


def _families() -> tuple[dict, list]:
    """Sentences and rules of licences that come in several kinds, made from the names above."""
    known, rules = {}, []
    for name, short in GNU.items():
        terms = f"you can redistribute it and or modify it under the terms of the {name}"
        for begin in ("this work is licensed under the", "licensed under the"):
            known[f"{begin} {name} version <v>"] = known[f"{begin} {name} v <v>"] = f"{short}ref-<v>"
        known[f"{terms} as published by the free software foundation"] = f"{short}redist"
        known[f"{terms} as published by the free software foundation either version <v> of the license or at your option any later version"] = f"{short}later-<v>"
        known[f"{terms} version <v> as published by the free software foundation"] = f"{short}only-<v>"
    for short in dict.fromkeys(GNU.values()):
        rules += [(["FreeSoft", f"{short}redist", f"AnyLater-{V}"], f"{short}-{{v}}-or-later"), (["FreeSoft", f"{short}later-{V}"], f"{short}-{{v}}-or-later"),
                  (["FreeSoft", f"{short}only-{V}"], f"{short}-{{v}}-only"), ([f"{short}ref-{V}"], f"{short}-{{v}}-only")]
    for name, short in CREATIVE.items():
        for begin in ("", "licensed under ", "licensed under a ", "licensed under the ", "this work is licensed under a ", "this work is licensed under the "):
            for end in ("", " international", " license", " international license"):
                known[f"{begin}creative commons {name} <v>{end}"] = f"CCref-{short}-<v>"
    kinds = SPDX | {f"cc {k.lower().replace('-', ' ')} <v>": f"CC-{k}-<v>" for k in CREATIVE.values()}
    for k in ("GPL", "LGPL", "AGPL"):
        kinds |= {f"{k.lower()} <v>": f"{k}-<v>", f"{k.lower()} <v> only": f"{k}-<v>-only", f"{k.lower()} <v> or later": f"{k}-<v>-or-later"}
    known |= {f"spdx license identifier {k}": f"SPDX-{name}" for k, name in kinds.items()}
    return known, rules


KNOWN = SENTENCES | NOTICES | OTHERS | _families()[0]
ALL_RULES = NOTICE_RULES + RULES + _families()[1] + OTHER_RULES
#: Every known sentence has one of these words.
WORDS = "licen|permission|software|redistribution|copyright|public domain|all rights reserved|creative commons|accompanying materials|mozilla"
#: "v. 2", "v2" and "v 2" are one; a plus behind the version of an SPDX name means later ones too.
VERSION_MARK, PLUS = r"\bv\.? ?([0-9])", r"(spdx-license-identifier: *[a-z]+-[0-9.]+)\+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rules(rules: list) -> list[tuple[str, str]]:
    """Patterns over ``;id;;id;`` and what they put in place of it; identifiers taken are marked by ``#``."""
    out = []
    for ids, name in rules:
        groups = "".join(f";{i};" for i in ids)
        out.append((groups, ";#" + name.replace("{v}", "$1").replace("{cc}", "$1$2") + ";"))
    return out


def known_sentences(text: Column, known: list[str]) -> Column:
    """The known sentences of a text in order, normalised: lower-case letters and digits with single blanks.

    One begins and ends at a stop, a line end or an end of the text, and may run over any line ends
    within; where several begin at one place, the longest stands.
    """
    low = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    low = F.regexp_replace(F.regexp_replace(low, PLUS, "$1 or later"), r"spdx-license-identifier: *", "spdx-license-identifier ")
    low = F.regexp_replace(low, VERSION_MARK, "v $1")
    # a dot within a number is kept, dots and colons within an address part nothing; any other ends a sentence, as do other stops
    kept = F.regexp_replace(low, r"([0-9])\.([0-9])", "$1\u0001$2")
    # each dot or colon of an address follows the one before it, however long the address is
    kept = F.regexp_replace(kept, r"(?:(://)|(?!\A)\G)([^\s.:]*+)[.:](?=[^\s])", "$1$2 ")
    kept = F.replace(kept, F.lit("://"), F.lit(" "))
    kept = F.regexp_replace(F.regexp_replace(kept, "[\n\r]+", "\u0003"), "[.!?;:]+", "\n")
    bare = F.regexp_replace(kept, "[^a-z0-9\u0001\u0003\n]+", " ")
    one = "|".join(s.replace(" ", "[ \u0003]++").replace("<v>", "[0-9]++(?:\u0001[0-9]++)*+") for s in sorted(known, key=lambda s: (-len(s), s)))
    found = F.regexp_extract_all(bare, F.lit(f"(?<![^\n\u0003]) *({one}) *(?![^\n\u0003])"), F.lit(1))
    return F.transform(found, lambda s: F.replace(F.regexp_replace(s, "[ \u0003]+", " "), F.lit("\u0001"), F.lit(".")))


def scan_licences(observations: DataFrame, obs_id: str = "obs_id", text: str = "text") -> DataFrame:
    """Licences named in observation texts.

    Returns one row per input row: obs_id, sentence_ids (identifiers of the known sentences in order,
    joined by commas), licences (names by rule in order of appearance, joined by commas), n_unmatched
    (identifiers that no rule took). Sentences that are not known are passed over and do not part a sequence.

    Null and empty texts have none of them. Repeated rows get equal results, null obs_id is kept, other
    columns are ignored, an empty table gives an empty result. Nothing is shuffled; a very long text
    costs the memory of its sentences. An SPDX line names one licence; expressions of several are not known.
    """
    rows = fields(observations, id=obs_id, text=text)
    version = r"(^| )([0-9]+(?:\.[0-9]+)*)(?= |$)"
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    # a text without one of these words has no known sentence
    some = F.translate(F.col("text"), CAPITALS, SMALL).rlike(WORDS)
    found = rows.withColumn("s", F.when(some, known_sentences(F.col("text"), list(KNOWN))))
    name = lambda s: F.element_at(known, F.regexp_replace(s, version, "$1<v>"))
    ids = F.filter(F.transform("s", lambda s: F.replace(name(s), F.lit("<v>"), F.regexp_extract(s, version, 2))), lambda x: x.isNotNull())
    out = found.withColumn("ids", F.coalesce(ids, F.array().cast("array<string>")))
    seq = F.concat_ws("", F.transform("ids", lambda x: F.concat(F.lit(";"), x, F.lit(";"))))
    for pattern, name in _rules(ALL_RULES):
        seq = F.regexp_replace(seq, pattern, name)
    out = out.withColumn("seq", F.when(F.size("ids") > 0, seq).otherwise(""))
    taken = F.transform(F.filter(F.split("seq", ";"), lambda x: x.startswith("#")), lambda x: F.substr(x, F.lit(2)))
    left = F.size(F.filter(F.split("seq", ";"), lambda x: (x != "") & ~x.startswith("#")))
    return out.select(F.col("id").alias(obs_id), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(taken, ",").alias("licences"), left.cast("long").alias("n_unmatched"))


def sql() -> str:
    """The same rules for the documents table; a sentence may run over sixteen lines."""
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in KNOWN.items()) + "}"
    seq = "list_aggregate(list_transform(ids, lambda x: ';' || x || ';'), 'string_agg', '')"
    for pattern, name in _rules(ALL_RULES):
        seq = f"regexp_replace({seq}, '{pattern}', '{name.replace('$', chr(92))}', 'g')"
    number = r"[0-9]+(\.[0-9]+)*"
    address = r"regexp_extract(x, '^[^\s]*')"
    return rf"""
WITH z AS MATERIALIZED (SELECT row_number() OVER () AS doc_id, doc_id AS own, text FROM documents),
a AS (SELECT doc_id, translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}') AS t FROM z),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '{PLUS}', '\1 or later', 'g'), 'spdx-license-identifier: *', 'spdx-license-identifier ', 'g'), '{VERSION_MARK}', 'v \1', 'g') AS t FROM a WHERE regexp_matches(t, '{WORDS}')),
c AS (SELECT doc_id, string_split(regexp_replace(t, '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '://') AS p FROM b),
d AS (SELECT doc_id, p[1] || array_to_string(list_transform(p[2:], lambda x: ' ' || translate(left({address}, -1), '.:', '  ') || right({address}, 1) || substr(x, length({address}) + 1)), '') AS t FROM c),
e AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '[.!?;:]+', chr(2), 'g'), chr(2))) AS part, generate_subscripts(string_split(regexp_replace(t, '[.!?;:]+', chr(2), 'g'), chr(2)), 1) AS k FROM d),
f AS (SELECT doc_id, k, list_transform(string_split(regexp_replace(part, '[\n\r]+', chr(3), 'g'), chr(3)), lambda l: replace(trim(regexp_replace(l, '[^a-z0-9\x01]+', ' ', 'g')), chr(1), '.')) AS lines FROM e),
g AS (SELECT doc_id, k, lines, unnest(range(1, len(lines) + 1)) AS i FROM f),
h AS (SELECT doc_id, k, i, j, trim(regexp_replace(array_to_string(lines[i:j], ' '), ' +', ' ', 'g')) AS s FROM g, unnest(range(i, least(i + 16, len(lines) + 1))) AS u(j) WHERE lines[i] <> '' AND lines[j] <> ''),
w AS (SELECT *, ({known})[array_to_string(list_transform(string_split(s, ' '), lambda w: CASE WHEN regexp_full_match(w, '{number}') THEN '<v>' ELSE w END), ' ')] AS id FROM h),
m AS (SELECT doc_id, k, i, max(j) AS j, arg_max(replace(id, '<v>', coalesce(list_filter(string_split(s, ' '), lambda w: regexp_full_match(w, '{number}'))[1], '')), j) AS id FROM w WHERE id IS NOT NULL GROUP BY ALL),
n AS (SELECT doc_id, list(id ORDER BY k, i) AS ids FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND o.k = m.k AND o.i < m.i AND o.j >= m.i) GROUP BY doc_id),
o AS (SELECT own AS doc_id, coalesce(ids, []) AS ids FROM z LEFT JOIN n USING (doc_id)),
q AS (SELECT doc_id, ids, CASE WHEN len(ids) > 0 THEN string_split({seq}, ';') ELSE [] END AS q FROM o)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_transform(list_filter(q, lambda x: starts_with(x, '#')), lambda x: x[2:]), ',') AS licences,
       len(list_filter(q, lambda x: x <> '' AND NOT starts_with(x, '#')))::BIGINT AS n_unmatched FROM q
"""
