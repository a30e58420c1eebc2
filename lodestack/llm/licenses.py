"""Operator 10, licence scans: canonical digests of entire texts.

A text is put into canonical form (case, copyright lines, punctuation, white
space and equivalent spellings no longer count) and the SHA-256 of that form is
looked up among the digests of known licences: of texts in ``KNOWN``, and of longer
ones, which ``DIGESTS`` holds without their text.

Defined results: a null or empty text, or one of copyright lines and punctuation
alone, has the digest of the empty form, which is no licence; texts of any length
are taken whole; repeated rows give repeated rows; an empty table gives an empty
table; only the id and the text are read; a null id stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import text_of

# Pairs of equivalent spellings, after the public guidelines for matching licence texts.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("all rights reserved", ""),
)

# Short public licence texts and notices that stand for a licence.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
}

# Digests (of the canonical form below) of whole licences as common distributions ship them (the test reads those texts, where they are).
DIGESTS: dict[str, str] = {
    "Apache-2.0": "1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea",
    "Artistic-1.0-Perl": "c6aebc79b70bfe6e6f1b9f8922db9a6e5427be3d7a3d18f91f97535efb97d614",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2": "bd8e32052e49e6b79fccbdd5dc03f7d40e45a8e895e3ecb79394b97961ffb127",
    "GFDL-1.3": "e7579a53c7b8214f091590d94bfe39deb978a080895ca5506448b8baf4f77985",
    "GPL-1.0": "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f",
    "GPL-2.0": "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6",
    "GPL-3.0": "42de4913c0ec220db6e274a84efcdc7a52715762d22943334032232048072bc1",
    "LGPL-2.0": "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e",
    "LGPL-2.1": "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}

#: A line that names the owner: "Copyright" and a name, in the spelling of a heading, which no sentence of a licence breaks into.
OWNER_LINE = r"(^|\n)[^\p{L}\p{N}\n]*[Cc]opyright[ \t]+(by[ \t]+)?\p{Lu}[^\n]*"
#: A whole line that states a copyright, with what stands before it but letters and digits.
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n]*(copyright[^\n]*([0-9]{4}|\(c\)|©)|(©|\(c\))[^\n]*[0-9]{4})[^\n]*"
APART = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The form in which equal licences are equal."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, OWNER_LINE, "\n")), COPYRIGHT_LINE, "\n")
    # Two spaces between words, so that each replacement finds its own pair around it.
    words = F.concat(F.lit(" "), F.regexp_replace(bare, APART, "  "), F.lit(" "))
    for a, b in EQUIVALENT:
        words = F.replace(words, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(words, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: dict[str, str] | None = None, digests: dict[str, str] | None = None) -> DataFrame:
    """license_digest, license_id: a row for each different digest (of equal ones, the smallest id)."""
    texts = list((KNOWN if known is None else known).items())
    more = list((DIGESTS if known is None and digests is None else digests or {}).items())
    rows = spark.createDataFrame(texts or [("", "")], "license_id string, text string")
    rows = rows.where(canonical(text_of()) != "").select(digest(text_of()).alias("license_digest"), "license_id")
    if more:
        rows = rows.unionByName(spark.createDataFrame(more, "license_id string, license_digest string"))
    return rows.groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def scan(df: DataFrame, known: dict[str, str] | None = None, digests: dict[str, str] | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, license_digest, license_id (null where the whole text is no known licence).

    ``known`` (id: text) and ``digests`` (id: digest) stand in for the lists of this module.
    """
    docs = df.select(F.col(f"`{id}`").alias("doc_id"), digest(text_of(f"`{text}`")).alias("license_digest"))
    # Broadcast: a row for each known licence, a list that comes with the call.
    return docs.join(F.broadcast(known_digests(df.sparkSession, known, digests)), "license_digest", "left").select("doc_id", "license_digest", "license_id")


def sql() -> str:
    """The same over ``documents``, for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(text: str) -> str:
        out = f"regexp_replace({text}, {quote(OWNER_LINE)}, chr(10), 'g')"
        out = f"' ' || regexp_replace(regexp_replace(lower({out}), {quote(COPYRIGHT_LINE)}, chr(10), 'g'), {quote(APART)}, '  ', 'g') || ' '"
        for a, b in EQUIVALENT:
            out = f"replace({out}, {quote(' ' + a.replace(' ', '  ') + ' ')}, {quote(' ' + b.replace(' ', '  ') + ' ')})"
        return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"

    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in KNOWN.items())
    more = "".join(f" UNION ALL SELECT {quote(v)}, {quote(k)}" for k, v in DIGESTS.items())
    return f"""
WITH known AS (
  SELECT d AS license_digest, min(id) AS license_id FROM (
    SELECT sha256({form('t')}) AS d, id FROM (VALUES {values}) AS v(id, t) WHERE {form('t')} <> ''{more})
  GROUP BY 1),
docs AS (SELECT doc_id, sha256({form("coalesce(text, '')")}) AS license_digest FROM documents)
SELECT doc_id, license_digest, license_id FROM docs LEFT JOIN known USING (license_digest)"""
