"""Licence scans by canonical digest lookup, in DataFrame functions only.

A text is made canonical: lower case, without copyright lines, signs as spaces, equivalent spellings made one, white
space collapsed. The digest of the whole canonical text is looked up in a table of known licences by hash join, and
so is that of each canonical line, for one-line notices. The table of known licences is a parameter; its size is
checked before it is broadcast. The built-in one holds short licences as texts and long ones as digests of their
canonical forms: as published, to the end of the terms (without the appendix), and the terms only.

Defined cases: null, empty and blank texts match nothing and have the digest of the empty text; a line or text made
only of copyright lines is empty; each input row gives one row, also when ids repeat or are null; notices are listed
once each, in order of name, with the number of lines that matched; a licence table with two names for one
canonical text gives the first name; a text of any length is one value of a row, its lines are rows; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that licence texts spell in more than one way (spaces stand for signs), and the form kept.
EQUIVALENTS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sub license", "sublicense"),
    ("sublicence", "sublicense"), ("sub licence", "sublicense"), ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("favour", "favor"), ("fulfil", "fulfill"), ("labour", "labor"), ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"), ("organisation", "organization"), ("per cent", "percent"), ("merchantibility", "merchantability"),
    ("whilst", "while"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("v2", "version 2"), ("v3", "version 3"),
    ("https", "http"),
)

_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~‘’“”–—«»©\t\r\x0b\x0c "
_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[^\p{L}\n]*(?:\(c\)|©|[0-9]{4})|\(c\)[^\p{L}\n]*[0-9]{4}|©)[^\n]*$"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: Digests of canonical forms of long licences, by name.
DIGESTS = (
    ("Apache-2.0", "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"),
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Apache-2.0", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)

#: Fixed values: (name, kind, text). Titles are variants of their own.
KNOWN = (
    ("MIT", "text", _MIT), ("MIT", "text", "MIT License\n\n" + _MIT), ("MIT", "text", "The MIT License (MIT)\n\n" + _MIT),
    ("BSD-2-Clause", "text", f"{_BSD_2}\n\n{_BSD_END}"), ("BSD-2-Clause", "text", f"BSD 2-Clause License\n\n{_BSD_2}\n\n{_BSD_END}"),
    ("BSD-3-Clause", "text", f"{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_END}"), ("BSD-3-Clause", "text", f"BSD 3-Clause License\n\n{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_END}"),
    ("ISC", "text", _ISC), ("ISC", "text", "ISC License\n\n" + _ISC),
    ("0BSD", "text", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("Unlicense", "text", _UNLICENSE), ("Unlicense", "text", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"), ("Unlicense", "text", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org/>"),
    ("Zlib", "text", _ZLIB), ("Zlib", "text", "zlib License\n\n" + _ZLIB),
    ("MIT", "notice", "Released under the MIT License."), ("MIT", "notice", "Licensed under the MIT License."), ("MIT", "notice", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "notice", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", 'Licensed under the Apache License, Version 2.0 (the "License");'), ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0", "notice", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "notice", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "notice", "This work is licensed under CC BY 4.0."),
)


def sign_characters() -> str:
    """What counts as a space between words."""
    return _SIGNS


def _words(text: Column) -> Column:
    """Canonical words, each between two spaces, lines kept."""
    c = F.lower(F.coalesce(text, F.lit("")))
    c = F.regexp_replace(c, _COPYRIGHT, "")
    c = F.translate(c, _SIGNS, " " * len(_SIGNS))
    c = F.regexp_replace(F.regexp_replace(c, " +", "  "), "(?m)^ *| *$", " ")
    for spelt, kept in EQUIVALENTS:
        c = F.replace(c, F.lit(f" {spelt.replace(' ', '  ')} "), F.lit(f" {kept.replace(' ', '  ')} "))
    return c


def _closed(words: Column) -> Column:
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def canonical(text: Column) -> Column:
    return _closed(_words(text))


def known_licences(spark: SparkSession, known: tuple = KNOWN, digests: tuple = DIGESTS) -> DataFrame:
    """(digest, licence, kind) of the canonical forms; digests: (name, digest) of whole texts known by digest only."""
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(known)], "place int, licence string, kind string, text string")
    rows = rows.select("place", "licence", "kind", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    more = spark.createDataFrame([(len(known) + i, n, "text", d) for i, (n, d) in enumerate(digests)], "place int, licence string, kind string, digest string")
    return rows.unionByName(more).groupBy("digest", "kind").agg(F.min_by("licence", "place").alias("licence"))


def scan_licences(docs: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """(id, text_digest, licence, notices, notice_lines) for each row of docs.

    licences has (digest, kind, licence); up to broadcast_rows of them (32 MB) are broadcast, else the join shuffles.
    """
    few = licences.limit(broadcast_rows + 1).count() <= broadcast_rows
    known = licences.select("digest", F.col("kind").alias("k_kind"), "licence")
    known = F.broadcast(known) if few else known
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), _words(F.col(text_col)).alias("words"))
    whole = F.array(F.struct(F.lit("text").alias("kind"), F.col("words").alias("unit")))
    lines = F.transform(F.split("words", "\n"), lambda x: F.struct(F.lit("notice").alias("kind"), x.alias("unit")))
    units = rows.select("row", "id", F.explode(F.concat(whole, lines)).alias("u")).select("row", "id", "u.kind", _closed(F.col("u.unit")).alias("unit"))
    units = units.filter("kind = 'text' or unit <> ''").select("row", "id", "kind", F.sha2("unit", 256).alias("digest"), F.col("unit").alias("unit"))
    met = units.join(known, (units["digest"] == known["digest"]) & (F.col("kind") == F.col("k_kind")) & (F.col("unit") != ""), "left").select("row", "id", "kind", units["digest"].alias("digest"), "licence")
    met = met.filter("kind = 'text' or licence is not null")
    text, notice = F.col("kind") == "text", F.col("kind") == "notice"
    out = met.groupBy("row", "id").agg(
        F.max(F.when(text, F.col("digest"))).alias("text_digest"), F.max(F.when(text, F.col("licence"))).alias("licence"),
        F.array_join(F.sort_array(F.collect_set(F.when(notice, F.col("licence")))), ",").alias("notices"), F.count_if(notice).alias("notice_lines"),
    )
    return out.drop("row")
