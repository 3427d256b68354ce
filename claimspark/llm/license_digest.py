"""License scan by canonical digest of whole texts.

A text is normalised (copyright notices dropped, lower case, punctuation and
white space to single blanks, equivalent spellings to one form) and its
SHA-256 is looked up among the digests of known licence texts, normalised
by the same expression.  Built-in functions only.

The known table is broadcast: it holds the texts below and in ``licenses/``, or a table of the
caller's whose rows are counted first; above ``max_broadcast_rows`` the
lookup is a plain shuffled join on the digest.  Known texts that share a
digest count as one, under the smallest licence id.

Edge cases: a null text counts as empty; an empty canonical text matches
nothing; repeated rows are looked up alike; an empty table gives an empty
result; the document's other columns are not touched.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence matching treats as equal.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber",
    "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor",
    "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses",
    "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize",
    "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "https": "http",
}
COPYRIGHT_LINE = r"(?mi)^[^\pL\pN\n]*(?:copyright\b|\(c\)[ \t]|©|all rights reserved)[^\n]*$"

# Words that follow "copyright" in licence wording, not in notices.
WORDING = ("also|and|are|as|claims?|disclaimers?|doctrines?|for|holders?|if|in|including|infringement|interests?|is|"
           "laws?|licen[cs]es?|like|lines?|more|notices?|of|on|or|owners?|ownership|patents?|permission|protection|"
           "resulting|statements?|the (?:library|program|software|work)|then|those|to|treat(?:y|ies)|under|was")
NOTICE_LINE = (r"(?m)^[^\pL\pN\n©]*(?:copyright\b(?=[^\pL\pN\n]*[\pL\pN])(?![^\pL\pN\n]*(?:" + WORDING + r")\b)[^\n]*"
               r"|\(c\)[ \t]+(?:copyright\b|[0-9]{4})[^\n]*|©[^\n]*|all rights reserved[^\pL\pN\n]*)$")

# Title lines that copies of untitled texts have.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License',
                     "Simplified BSD License", "BSD License", "The BSD License", "The BSD 2-Clause License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License',
                     "New BSD License", "Modified BSD License", "BSD License", "The BSD License",
                     "The BSD 3-Clause License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "NCSA": ("University of Illinois/NCSA Open Source License",),
}
TERMS_END = "END OF TERMS AND CONDITIONS"
TEXTS = Path(__file__).with_name("licenses")

# Public licence texts, without their copyright lines.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to
use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such,
and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from
any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND
MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.""",
}


def canonical(text: Column, line: str = COPYRIGHT_LINE) -> Column:
    """The normal form of a licence text: words of letters and digits, without
    the matches of ``line``."""
    t = F.lower(F.coalesce(text, F.lit("")))
    noted = F.lit(False)
    for mark in ("copyright", "(c)", "\u00a9", "all rights reserved"):
        noted = noted | t.contains(mark)
    t = F.when(noted, F.regexp_replace(t, line, "")).otherwise(t)
    # each word keeps blanks of its own on both sides, so that neighbouring
    # words can both be replaced
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\pL\pN]+", "  "), F.lit(" "))
    spelt = t
    for a, b in SPELLINGS.items():
        spelt = F.replace(spelt, F.lit(f" {a} "), F.lit(f" {b} "))
    # one look for any of the spellings saves most texts the replacements
    t = F.when(t.rlike(f" (?:{'|'.join(SPELLINGS)}) "), spelt).otherwise(t)
    return F.trim(F.regexp_replace(t, " +", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical text, lower-case hex."""
    return F.sha2(canonical(text), 256)


def known_texts() -> list[tuple[str, str]]:
    """(licence id, text) of the texts above and of the published ones beside
    this module; also under their titles, and without what follows the terms."""
    texts = [*KNOWN.items(), *((p.name.removesuffix(".txt"), p.read_text("utf-8")) for p in sorted(TEXTS.glob("*.txt")))]
    texts += [(i, t[:t.index(TERMS_END) + len(TERMS_END)]) for i, t in texts if TERMS_END in t]
    return texts + [(i, f"{title}\n\n{t}") for i, t in texts for title in TITLES.get(i, ())]


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_texts(), "license_id string, text string")


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_broadcast_rows: int = 100_000) -> DataFrame:
    """(id, n_canonical, digest, license_id): the known licence that the
    whole text is, else null.  ``digest`` is of the text without any line that
    begins with a copyright mark; looked up first is the text without notices
    only, which does not depend on where the licence's own lines break."""
    def lookup(line: str, key: str) -> DataFrame:
        found = (known.select(canonical(F.col("text"), line).alias("c"), "license_id").where("c <> ''")
                 .groupBy(F.sha2("c", 256).alias(key)).agg(F.min("license_id").alias(f"{key}_id")))
        return F.broadcast(found) if few else found

    few = known.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    own = docs.select(F.col(id_col), canonical(F.col(text_col)).alias("c"),
                      canonical(F.col(text_col), NOTICE_LINE).alias("whole")) \
        .select(id_col, F.length("c").cast("bigint").alias("n_canonical"), F.sha2("c", 256).alias("digest"),
                F.sha2("whole", 256).alias("whole"))
    return own.join(lookup(NOTICE_LINE, "whole"), "whole", "left").join(lookup(COPYRIGHT_LINE, "digest"), "digest", "left") \
        .select(id_col, "n_canonical", "digest", F.coalesce("whole_id", "digest_id").alias("license_id"))
