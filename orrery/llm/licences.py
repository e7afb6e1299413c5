"""Licence scan by canonical digests.

A text is cut into lines; each is lower-cased, stripped of punctuation and rewritten to one
spelling of equivalent words.  Copyright lines go.  The digest of the remaining words is
hash-joined to the digests of known licence texts; the digests of the single lines are joined
to those of known one-line notices.  Known texts pass through the same expressions.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_KNOWN = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII other than letters and digits.
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Equivalent spellings, the left one is rewritten to the right one.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("percent", "per cent"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("http", "https"),
)
COPYRIGHT = ("copyright ", "c copyright ", "© copyright ", "© ", "all rights reserved")

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Parts of Creative Commons names: the id, and the word of the long name.
_CC_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
_CC_NAMES = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
_CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
_NOTICES = ("Licensed under {}.", "Licensed under the {} License.", "Released under {}.", "Released under the {} License.", "This work is licensed under {}.", "This work is licensed under a {} License.", "This work is licensed under the {} License.")


def _creative_commons() -> tuple[tuple[str, str, str], ...]:
    """One-line notices of every Creative Commons licence and version, in its short and long names."""
    rows = {}
    for name in _CC_NAMES:
        for version, kind in _CC_VERSIONS.items():
            long = f"Creative Commons {'-'.join(_CC_PARTS[p] for p in name.split('-'))} {version}"
            for spelling in (f"CC {name} {version}", f"CC-{name}-{version}", f"Creative Commons {name} {version}", long, f"{long} {kind}"):
                for notice in _NOTICES:
                    rows["line", f"CC-{name}-{version}", notice.format(spelling)] = None
    return tuple(rows)


CREATIVE_COMMONS = _creative_commons()
#: Whole texts below ``texts``, one file a licence, named by its id.
COMMON_TEXTS = tuple(("text", path.stem, path.read_text("utf-8")) for path in sorted((Path(__file__).parent / "texts").glob("*.txt")))

#: Public licence texts (kind ``text``) and one-line notices (kind ``line``).
KNOWN = (
    ("text", "MIT", f"MIT License\n{_GRANT}\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}"),
    ("text", "MIT", f"{_GRANT}\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}"),
    ("text", "ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("text", "0BSD", f"{_ISC}.\n{_ISC_END}"),
    ("text", "BSD-2-Clause", f"{_BSD}{_BSD_END}"),
    ("text", "BSD-3-Clause", f"{_BSD}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_END}"),
    ("line", "MIT", "Released under the MIT License."),
    ("line", "MIT", "This project is licensed under the MIT License."),
    ("line", "MIT", "Licensed under the MIT License."),
    ("line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("line", "Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("line", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("line", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("line", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("line", "BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("line", "BSD-2-Clause", "Released under the BSD 2-Clause License."),
    *CREATIVE_COMMONS,
    *COMMON_TEXTS,
)


def canonical_line(line: Column) -> Column:
    """Words of a line, each between blanks of its own, in one spelling."""
    words = F.regexp_replace(F.translate(line, UPPER, LOWER), PUNCTUATION, "  ")
    padded = F.concat(F.lit("  "), words, F.lit("  "))
    for old, new in SPELLINGS:
        padded = F.replace(padded, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.replace(F.btrim(padded), F.lit("  "), F.lit(" "))


def canonical_lines(text: Column) -> Column:
    """Canonical lines without empty ones and copyright lines."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), canonical_line)
    is_copyright = lambda x: F.exists(F.array(*map(F.lit, COPYRIGHT)), lambda p: F.startswith(x, p))
    return F.filter(lines, lambda x: (F.length(x) > 0) & ~is_copyright(x))


def digest_of(lines: Column) -> Column:
    """SHA-256 of the canonical words; null if there are none."""
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def known_licences(spark: SparkSession) -> DataFrame:
    """``(kind, license_id, text)``."""
    return spark.createDataFrame(KNOWN, "kind string, license_id string, text string")


def scan_licences(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text_sha256, license_id, notices, n_notices)`` of every row.

    ``license_id`` is the licence whose text is the whole document (the smallest, if several
    share a text), else null; ``notices`` are the licences that single lines name, sorted and
    comma-joined.  Rows that repeat an id keep a result each, equal ones are looked up once.  Null
    texts and texts without words have a null digest and match nothing.
    """
    prints = known.withColumn("lines", canonical_lines(F.col("text"))).select("kind", "license_id", digest_of(F.col("lines")).alias("digest")).where("digest is not null")
    prints = prints.groupBy("kind", "digest").agg(F.min("license_id").alias("known_id"))
    if known.limit(MAX_KNOWN + 1).count() <= MAX_KNOWN:
        prints = F.broadcast(prints)
    rows = docs.select(F.col(id_col).alias("__id"), canonical_lines(F.col(text_col)).alias("lines"))
    rows = rows.select("__id", digest_of(F.col("lines")).alias("whole"), F.array_distinct("lines").alias("lines")).withColumn("same", F.xxhash64("lines"))
    line_keys = F.transform("lines", lambda x: F.struct(F.lit("line").alias("kind"), F.sha2(x, 256).alias("digest")))
    keys = F.concat(F.array(F.struct(F.lit("text").alias("kind"), F.col("whole").alias("digest"))), line_keys)
    each = rows.select("__id", "whole", "same", F.explode(keys).alias("k")).select("__id", "whole", "same", "k.kind", "k.digest")
    met = each.join(prints, ["kind", "digest"], "left")
    out = met.groupBy("__id", "whole", "same").agg(
        F.count_if(F.col("kind") == "text").cast("int").alias("copies"),  # each row has one key of this kind
        F.min(F.when(F.col("kind") == "text", F.col("known_id"))).alias("license_id"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "line", F.col("known_id")))).alias("names"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        F.col("__id").alias(id_col),
        F.col("whole").alias("text_sha256"),
        "license_id",
        F.array_join("names", ",").alias("notices"),
        F.size("names").cast("long").alias("n_notices"),
    )
