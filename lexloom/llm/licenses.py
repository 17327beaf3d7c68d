"""Licence notices in texts, recognised as sequences of known sentences, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences by identifier, as they read without case and punctuation.
SENTENCES = {
    "apache_named": "licensed under the apache license version 2 0",
    "apache_the_license": "licensed under the apache license version 2 0 the license",
    "apache_may_not_use": "you may not use this file except in compliance with the license",
    "apache_obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache_unless": "unless required by applicable law or agreed to in writing software distributed under the license is "
    "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit_named": "released under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the software",
    "gpl3_named": "this work is licensed under the gnu general public license version 3",
    "gpl_redistribute": "this program is free software",
    "gpl_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
    "the free software foundation",
    "gpl3_or_later": "either version 3 of the license or at your option any later version",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution",
    "cc_by_nc_4": "licensed under cc by nc 4 0",
    "cc_by_4": "licensed under cc by 4 0",
    "cc_by_sa_4": "licensed under cc by sa 4 0",
    "all_rights": "all rights reserved",
    "apache_asf": "the asf licenses this file to you under the apache license version 2 0 the license",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "mit_grant_whole": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction including without limitation "
    "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions",
    "mit0_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights "
    "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
    "whom the software is furnished to do so",
    "gpl_library": "this library is free software",
    "bsd_neither": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission",
    "bsd_university": "neither the name of the university nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_grant_and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd0_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and "
    "to alter it and redistribute it freely subject to the following restrictions",
    "boost_named": "distributed under the boost software license version 1 0",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software "
    "and accompanying documentation covered by this license the software to use reproduce display distribute execute and "
    "transmit the software and to prepare derivative works of the software and to permit third parties to whom the software "
    "is furnished to do so all subject to the following",
    "mpl2_terms": "this source code form is subject to the terms of the mozilla public license v",
    "epl2_terms": "this program and the accompanying materials are made available under the terms of the eclipse public "
    "license 2 0 which is available at https www eclipse org legal epl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

#: GNU notices: one sentence in version 3's wording, parted by semicolons in older ones.
GNU = {"gpl": ("General Public", ("2", "3")), "lgpl": ("Lesser General Public", ("2.1", "3")), "agpl": ("Affero General Public", ("3",))}
for _short, (_name, _versions) in GNU.items():
    _terms = f"you can redistribute it and or modify it under the terms of the gnu {_name.lower()} license"
    SENTENCES.setdefault(f"{_short}_terms", f"{_terms} as published by the free software foundation")
    for _version in _versions:
        _digits = _version.replace(".", " ")
        _later = f"either version {_digits} of the license or at your option any later version"
        SENTENCES.setdefault(f"gpl{_digits.replace(' ', '_')}_or_later", _later)
        SENTENCES[f"{_short}{_digits.replace(' ', '_')}_whole"] = f"{_terms} as published by the free software foundation {_later}"
        SENTENCES[f"{_short}{_digits.replace(' ', '_')}_only"] = f"{_terms} version {_digits} as published by the free software foundation"

CC = {
    "by": ("Attribution", "permissive"),
    "by-sa": ("Attribution-ShareAlike", "copyleft"),
    "by-nd": ("Attribution-NoDerivatives", "no derivatives"),
    "by-nc": ("Attribution-NonCommercial", "non-commercial"),
    "by-nc-sa": ("Attribution-NonCommercial-ShareAlike", "non-commercial"),
    "by-nc-nd": ("Attribution-NonCommercial-NoDerivatives", "non-commercial"),
}
for _short, (_name, _) in CC.items():
    SENTENCES.setdefault(f"cc_{_short.replace('-', '_')}_4", f"licensed under cc {_short.replace('-', ' ')} 4 0")
    SENTENCES[f"cc_{_short.replace('-', '_')}_4_work"] = (
        f"this work is licensed under a creative commons {_name.lower().replace('-', ' ')} 4 0 international license"
    )

#: Identifiers that SPDX tags name, with the kinds of their licences.
SPDX = {
    "permissive": ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "CC-BY-4.0"),
    "public domain": ("0BSD", "MIT-0", "Unlicense", "CC0-1.0"),
    "copyleft": (
        *(f"{name}-{version}-{which}" for name, versions in (("GPL", ("2.0", "3.0")), ("LGPL", ("2.1", "3.0")), ("AGPL", ("3.0",)))
          for version in versions for which in ("only", "or-later")),
        *("GPL-2.0", "GPL-2.0+", "GPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "CC-BY-SA-4.0"),
    ),
    "non-commercial": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"),
}
SPDX_TAGS = {
    "spdx_" + tag.lower().replace("-", "_").replace(".", "_").replace("+", "_plus"): (tag, kind) for kind, tags in SPDX.items() for tag in tags
}
SENTENCES |= {
    name: "spdx license identifier " + tag.lower().replace("-", " ").replace(".", " ").replace("+", " plus")
    for name, (tag, _) in SPDX_TAGS.items()
}

# Rules in the order in which they are tried: name, kind, identifiers one after another.
RULES = (
    ("Apache-2.0 notice", "permissive", ("apache_the_license", "apache_may_not_use", "apache_obtain", "apache_unless")),
    ("Apache-2.0 notice", "permissive", ("apache_the_license", "apache_may_not_use")),
    ("MIT text", "permissive", ("mit_grant", "mit_notice")),
    ("MIT text", "permissive", ("mit_grant",)),
    ("GPL-3.0-or-later notice", "copyleft", ("gpl_redistribute", "gpl_terms", "gpl3_or_later")),
    ("GPL notice", "copyleft", ("gpl_redistribute", "gpl_terms")),
    ("BSD text", "permissive", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD text", "permissive", ("bsd_grant",)),
    ("Apache-2.0", "permissive", ("apache_named",)),
    ("Apache-2.0", "permissive", ("apache_the_license",)),
    ("MIT", "permissive", ("mit_named",)),
    ("GPL-3.0", "copyleft", ("gpl3_named",)),
    ("CC-BY-NC-4.0", "non-commercial", ("cc_by_nc_4",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc_by_sa_4",)),
    ("CC-BY-4.0", "permissive", ("cc_by_4",)),
    ("all rights reserved", "proprietary", ("all_rights",)),
    ("Apache-2.0 notice", "permissive", ("apache_asf", "apache_may_not_use")),
    ("MIT text", "permissive", ("mit_grant_whole", "mit_notice")),
    ("MIT text", "permissive", ("mit_grant_whole",)),
    ("MIT-0 text", "public domain", ("mit0_grant",)),
    *(
        (f"{short.upper()}-{version}{'' if '.' in version else '.0'}-or-later notice", "copyleft", (f"gpl_{opening}", *rest))
        for short, (_, versions) in GNU.items()
        for version in versions
        for mark in (version.replace(".", "_"),)
        for opening in ("redistribute", "library")
        for rest in ((f"{short}{mark}_whole",), (f"{short}_terms", f"gpl{mark}_or_later"))
        if (short, version, opening) != ("gpl", "3", "redistribute") or len(rest) == 1
    ),
    *(
        (f"{short.upper()}-{version}{'' if '.' in version else '.0'}-only notice", "copyleft", (f"{short}{version.replace('.', '_')}_only",))
        for short, (_, versions) in GNU.items()
        for version in versions
    ),
    ("LGPL notice", "copyleft", ("lgpl_terms",)),
    ("AGPL notice", "copyleft", ("agpl_terms",)),
    ("ISC text", "permissive", ("isc_grant",)),
    ("ISC text", "permissive", ("isc_grant_and",)),
    ("0BSD text", "public domain", ("bsd0_grant",)),
    ("Zlib text", "permissive", ("zlib_grant",)),
    ("BSL-1.0", "permissive", ("boost_named",)),
    ("BSL-1.0 text", "permissive", ("boost_grant",)),
    ("MPL-2.0 notice", "copyleft", ("mpl2_terms",)),
    ("EPL-2.0 notice", "copyleft", ("epl2_terms",)),
    ("Unlicense text", "public domain", ("unlicense",)),
    *((f"CC-{short.upper()}-4.0", kind, (f"cc_{short.replace('-', '_')}_4_work",)) for short, (_, kind) in CC.items()),
    *((f"CC-{short.upper()}-4.0", CC[short][1], (f"cc_{short.replace('-', '_')}_4",)) for short in ("by-nd", "by-nc-sa", "by-nc-nd")),
    *((tag, kind, (name,)) for name, (tag, kind) in SPDX_TAGS.items()),
)

#: Longer notices first, so that none stands behind a rule that would use its first sentences up.
RULES = tuple(sorted(RULES, key=lambda rule: -len(rule[2])))

#: Every known sentence has one of these words, so a text without them has no known sentence.
HINTS = ("licens", "permission", "copyright", "redistribut", "free software", "reserved", "public domain")
#: Other sentences, list numbers (which don't part the sentences of a rule) and sentences that a rule has used up.
OTHER, NUMBER, USED = ".", ",", "_"
#: A sentence ends at . ! ? ; or : before white space, or at a line end.
SENTENCE_END = r"[.!?;:][\x20\x09-\x0D]+|\n"
MARKS = {name: chr(ord("A") + at if at < 26 else ord("a") + at - 26 if at < 52 else 0x100 + at) for at, name in enumerate(SENTENCES)}
#: What parts the pieces of a text: the end of a sentence or paragraph, and a line end, over which a sentence may go on.
HARD, SOFT = "\x01", "\x02"


def pieces(text: Column) -> Column:
    """A text in lower case with its sentences and lines between HARD and SOFT, one space in place of anything else.

    White space in them is that of SENTENCE_END. Comment signs go with other signs, so that a line of signs alone parts
    paragraphs, as a blank one does. An address at the start of a line is on display and no part of the sentence before it.
    """
    one = F.regexp_replace(F.translate(F.lower(text), HARD + SOFT, "  "), r"spdx-license-identifier:[\x20\x09]*", "spdx-license-identifier ")
    one = F.regexp_replace(one, r"(?<=spdx-license-identifier [a-z]{3,4}-[0-9]\.[0-9])\+", " plus")
    one = F.regexp_replace(one, r"(?m)^[\x20\x09]*(?:rem|dnl)(?=[\x20\x09\n])", "")
    one = F.regexp_replace(one, r"[.!?;:][\x20\x09-\x0D]+|\n(?=[^a-z0-9\n]*https?://)", HARD)
    one = F.regexp_replace(one, r"\n[^a-z0-9\n\x01]*(?=\n)", HARD)
    one = F.regexp_replace(one, "\n", SOFT)
    one = F.regexp_replace(one, "[^a-z0-9\x01\x02]+", " ")
    one = F.regexp_replace(F.concat(F.lit(HARD), one, F.lit(HARD)), "[ \x01\x02]*\x01[ \x01\x02]*", HARD)
    return F.regexp_replace(one, " ?\x02[ \x02]*", SOFT)


def sentence_marks(text: Column) -> Column:
    """One character for each known sentence and each other piece: an identifier's mark, a comma for a number, or a point.

    A known sentence is a whole piece, or several that only line ends part; longer ones are looked for first.
    """
    found = pieces(text)
    for name, words in sorted(SENTENCES.items(), key=lambda one: -len(one[1])):
        found = F.regexp_replace(found, f"(?<=[\x01\x02]){words.replace(' ', '[ \x02]')}(?=[\x01\x02])", "=" + MARKS[name])
    each = F.filter(F.split(found, "[\x01\x02]"), lambda one: one != "")
    kind = lambda one: F.when(one.startswith("="), F.substring(one, 2, 1)).when(one.rlike("^([0-9]{1,2}|[a-z])$"), NUMBER).otherwise(OTHER)
    return F.when(F.lower(text).rlike("|".join(HINTS)), F.array_join(F.transform(each, kind), "")).otherwise("")


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_known, identifiers, licenses, kinds, first_sentence) of every row's whole text.

    A sentence may be wrapped over lines, with comment signs before them; blank lines and end marks part sentences. Numbers of
    a list don't part the sentences of a rule. identifiers names the known sentences in order, with / where other sentences part them. Rules are tried in order, and
    the sentences that a rule matched are used up, so a longer notice that stands first is not also found as a shorter
    one. licenses names the rules that matched, each once, in rule order; first_sentence is the number of the first known
    sentence, from 0. A null or empty text, and one without a known sentence, has none of them: empty strings, 0 and null.
    Repeated rows and null ids come out as they went in. Other columns are not read. Nothing is shuffled.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(sentence_marks(F.col(text_column)), F.lit("")).alias("marks"))
    rows = rows.select("doc_id", F.replace("marks", F.lit(NUMBER), F.lit(OTHER)).alias("marks"), F.replace("marks", F.lit(NUMBER), F.lit("")).alias("step0"))
    for at, (_, _, names) in enumerate(RULES):
        wanted = "".join(MARKS[name] for name in names)
        rows = rows.withColumn(f"step{at + 1}", F.replace(F.col(f"step{at}"), F.lit(wanted), F.lit(USED * len(wanted))))
    matched = [F.col(f"step{at}") != F.col(f"step{at + 1}") for at in range(len(RULES))]
    names = F.array_distinct(F.array_compact(F.array(*(F.when(hit, rule[0]) for hit, rule in zip(matched, RULES, strict=True)))))
    kinds = F.array_sort(
        F.array_distinct(F.array_compact(F.array(*(F.when(hit, rule[1]) for hit, rule in zip(matched, RULES, strict=True)))))
    )
    known = F.regexp_replace("marks", r"^\.+|\.+$", "")
    known = F.regexp_replace(known, r"\.+", "/")
    by_mark = F.create_map(*(F.lit(value) for name, mark in MARKS.items() for value in (mark, name)), F.lit("/"), F.lit("/"))
    spelled = F.array_join(F.transform(F.filter(F.split(known, ""), lambda mark: mark != ""), lambda mark: by_mark[mark]), " ")
    return rows.select(
        "doc_id",
        F.length(F.regexp_replace("marks", r"\.", "")).cast("long").alias("n_known"),
        spelled.alias("identifiers"),
        F.array_join(names, ", ").alias("licenses"),
        F.array_join(kinds, ", ").alias("kinds"),
        F.when(known != "", F.length(F.regexp_extract("marks", r"^\.*", 0)).cast("long")).alias("first_sentence"),
    )


def scan_sql() -> str:
    """The same rows in SQL, for texts whose known sentences stand on one line and are no SPDX tags or numbered lists."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    known = "MAP {" + ", ".join(f"{quoted(words)}: {quoted(MARKS[name])}" for name, words in SENTENCES.items()) + "}"
    spelled = "MAP {" + ", ".join(f"{quoted(mark)}: {quoted(name)}" for name, mark in [*MARKS.items(), ("/", "/")]) + "}"
    steps, at = [], "marks"
    for number, (_, _, names) in enumerate(RULES):
        wanted = "".join(MARKS[name] for name in names)
        steps.append(f"s{number + 1} AS (SELECT *, replace({at}, '{wanted}', '{USED * len(wanted)}') AS t{number + 1} FROM s{number})")
        at = f"t{number + 1}"
    befores = ["marks", *(f"t{number + 1}" for number in range(len(RULES)))]

    def listed(part: int) -> str:
        return "[" + ", ".join(f"CASE WHEN {befores[n]} <> t{n + 1} THEN {quoted(rule[part])} END" for n, rule in enumerate(RULES)) + "]"

    return f"""
WITH sentences AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '{SENTENCE_END}'),
    lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS each FROM documents),
s0 AS (SELECT doc_id, CASE WHEN len(list_filter(each, lambda s: ({known})[s] IS NOT NULL)) > 0
    THEN array_to_string(list_transform(each, lambda s: coalesce(({known})[s], '.')), '') ELSE '' END AS marks FROM sentences),
{", ".join(steps)}
SELECT doc_id, length(replace(marks, '.', '')) AS n_known,
  array_to_string(list_transform(list_filter(string_split(regexp_replace(trim(marks, '.'), '\\.+', '/', 'g'), ''), lambda m: m <> ''),
    lambda m: ({spelled})[m]), ' ') AS identifiers,
  array_to_string(list_filter(list_transform(range({len(RULES)}), lambda i: CASE WHEN list_position(names, names[i + 1]) = i + 1
    THEN names[i + 1] END), lambda n: n IS NOT NULL), ', ') AS licenses,
  array_to_string(list_sort(list_distinct(kinds)), ', ') AS kinds,
  CASE WHEN trim(marks, '.') <> '' THEN length(marks) - length(ltrim(marks, '.')) END AS first_sentence
FROM (SELECT *, {listed(0)} AS names, list_filter({listed(1)}, lambda k: k IS NOT NULL) AS kinds FROM s{len(RULES)})
"""
