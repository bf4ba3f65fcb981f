"""Licences in text: known sentences become identifiers, ordered rules match their sequence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Known licence sentences, normalised as `lines` does it, with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-2.0-ref",
    "you may not use this file except in compliance with the license": "apache-terms",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "mit-as-is",
    "this work is licensed under the gnu general public license version 3": "gpl-3-ref",
    "this work is licensed under the gnu general public license version 2": "gpl-2-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-grant",
    "either version 3 of the license or at your option any later version": "gpl-3-later",
    "either version 2 of the license or at your option any later version": "gpl-2-later",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-ref",
    "licensed under cc by 4 0": "cc-by-4.0-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-ref",
    "this work is licensed under the creative commons attribution 4 0 international license": "cc-by-4.0-ref",
    "this work is licensed under the creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4.0-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all rights reserved": "rights-reserved",
    # as the licences' own texts have them
    "licensed under the apache license version 2 0 the license": "apache-2.0-ref",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-as-is",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "this program is free software": "gpl-program",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-later-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-later-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl-2-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl-3-grant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
}

#: Ordered rules: identifiers in this order, side by side, are the licence. Longer ones come first,
#: and what a rule has matched is gone for later ones.
RULES = [
    ("Apache-2.0", ["apache-2.0-ref", "apache-terms", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-2.0-ref", "apache-terms"]),
    ("Apache-2.0", ["apache-2.0-ref"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-ref"]),
    ("GPL-3.0-or-later", ["gpl-program", "gpl-3-later-grant"]),
    ("GPL-2.0-or-later", ["gpl-program", "gpl-2-later-grant"]),
    ("GPL-3.0-or-later", ["gpl-program", "gpl-grant", "gpl-3-later"]),
    ("GPL-2.0-or-later", ["gpl-program", "gpl-grant", "gpl-2-later"]),
    ("GPL-3.0", ["gpl-program", "gpl-3-grant"]),
    ("GPL-2.0", ["gpl-program", "gpl-2-grant"]),
    ("GPL-3.0-or-later", ["gpl-3-later-grant"]),
    ("GPL-2.0-or-later", ["gpl-2-later-grant"]),
    ("GPL-3.0", ["gpl-3-grant"]),
    ("GPL-2.0", ["gpl-2-grant"]),
    ("GPL-3.0-or-later", ["gpl-grant", "gpl-3-later"]),
    ("GPL-2.0-or-later", ["gpl-grant", "gpl-2-later"]),
    ("GPL-3.0", ["gpl-3-ref"]),
    ("GPL-2.0", ["gpl-2-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-ref"]),
    ("CC-BY-4.0", ["cc-by-4.0-ref"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("All rights reserved", ["rights-reserved"]),
]


#: Ends of sentences, and ends of lines inside them, in `lines`.
CUT, LINE = "\x01", "\x02"


def lines(text: Column) -> Column:
    """The text in lower case, with every run of other characters than letters and digits as one
    space; CUT stands for . ! ? ; : before white space, for blank lines and for both ends of the text,
    LINE for other line ends. Marks of comments and lists at line heads go."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    text = F.translate(text, CUT + LINE, "  ")
    # marks, then a number or letter of a list or a comment word, then marks; a line of marks alone is blank
    head = r"(^|\n)[^\p{L}\p{N}\n]*+(?:(?:\(?[0-9a-z]{1,2}[.)]|dnl|rem)[ \t]++[^\p{L}\p{N}\n]*+)?"
    text = F.regexp_replace(text, head, "$1")
    text = F.regexp_replace(text, r"[.!?;:]\s++|\n{2,}+", CUT)
    text = F.translate(text, "\n", LINE)
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\x01\x02]++", " ")
    text = F.regexp_replace(text, r"[ \x02]*+\x01[ \x01\x02]*+", CUT)
    text = F.regexp_replace(text, r" ?\x02[ \x02]*+", LINE)
    return F.concat(F.lit(CUT), F.trim(text), F.lit(CUT))


def known_sentences(text: Column, known: list) -> Column:
    """Those of the known sentences that stand in a text, in order. They begin and end at the
    beginning and end of a sentence or of a line, and may run over ends of lines; of
    sentences that begin at the same place the longest counts."""
    plain = sorted({s for s in known if s.strip()}, key=lambda s: (-len(s), s))
    if not plain:
        return F.array().cast("array<string>")
    one = "|".join(rf"[ {LINE}]".join(re.escape(w) for w in s.split(" ")) for s in plain)
    found = F.regexp_extract_all(lines(text), F.lit(rf"(?<=[{CUT}{LINE}])(?:{one})(?=[ ]?[{CUT}{LINE}])"), F.lit(0))
    return F.transform(found, lambda s: F.translate(s, LINE, " "))


def find_licenses(docs: DataFrame, text_col: str = "text", known: dict | None = None, rules: list | None = None) -> DataFrame:
    """All rows with `sentence_ids` (identifiers of known sentences in order), `licenses` (those
    that rules give, in the order of the text) and `unmatched` (identifiers no rule took).

    A sentence may run over several lines, also of a comment; a line end alone ends one as well.
    Sentences that aren't known break no sequence. The rules run in their order over the whole
    sequence; each replaces what it matches. Null and empty texts have empty arrays. Repeated rows
    and null ids are rows like others; an empty table gives an empty result. Columns named like
    the new ones are replaced, all others kept. `known` and `rules` are small tables of the caller's.
    """
    known, rules = SENTENCES if known is None else known, RULES if rules is None else rules
    added = ("sentence_ids", "licenses", "unmatched")
    texts = F.array(*[F.lit(s) for s in known])
    ids = F.array(*[F.lit(i) for i in known.values()])
    place = F.filter(
        F.transform(known_sentences(F.col(text_col), list(known)), lambda s: F.array_position(texts, s).cast("int")), lambda i: i > 0
    )
    found = docs.drop(*[c for c in added if c != text_col]).withColumn("sentence_ids", F.transform(place, lambda i: F.get(ids, i - 1)))
    # identifiers as <id>, recognised licences as {number of the rule}
    line = F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    for number, (_, wanted) in enumerate(rules):
        line = F.replace(line, F.lit("".join(f"<{i}>" for i in wanted)), F.lit(f"{{{number}}}"))
    names = F.array(*[F.lit(name) for name, _ in rules])
    numbers = F.regexp_extract_all("__line", F.lit(r"\{([0-9]+)\}"), F.lit(1))
    return (
        found.withColumn("__line", line)
        .withColumn("licenses", F.transform(numbers, lambda i: F.get(names, i.cast("int"))))
        .withColumn("unmatched", F.regexp_extract_all("__line", F.lit("<([^>]+)>"), F.lit(1)))
        .drop("__line")
    )
