"""Licence scans by canonical digest: a whole text, normalised, is hash-joined to the digests of known licences.

Normalising, in this order: lower case; copyright lines go (a line that says more than a copyright line can stays, so that a
text in one line isn't lost for its statement); equivalent spellings are made one; every run of characters
that aren't letters or digits becomes one space; the ends are trimmed. The digest is SHA-256 of what is left. All of it
is built-in column functions, one pass without a shuffle of the documents. The known licences are a parameter, the texts
of each id; by default LICENSES, LINES and the whole texts in license_texts/ (with and without what follows their terms).
A whole GNU text doesn't say whether later versions hold too, so its id has no "only" or "or-later". A text is looked
up as a whole: a licence line within a longer document isn't found.

Defined results: a null or empty text, or one of punctuation alone, has an empty canonical text, its digest is null and
it matches nothing; repeated rows are matched alike; a null doc_id is kept; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and their replacements, in order of use, on lower-cased text. The syntax is common to Java and RE2.
RULES: list[tuple[str, str]] = [
    (r"(?m)^[^\n]{0,40}(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9]{4})[^\n]{0,200}$", " "),
    (r"(?m)^[ \t]*all rights reserved\.?[ \t]*$", " "),
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-infringement", "noninfringement"),
    (r"merchantibility", "merchantability"),
    (r"https:", "http:"),
    (r"&", " and "),
    (r"[^\p{L}\p{N}]+", " "),
]

# The texts of known short licences and notices, without their copyright lines.
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_MIT_NONE = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_NONE = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_NONE = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_UNLICENSE = 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>'
LICENSES: dict[str, list[str]] = {
    "MIT": [
        f"MIT License\n\n{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_NONE}",
        f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_NONE}",
        "Released under the MIT License."
    ],
    "MIT-0": [f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_MIT_NONE}"],
    "BSD-2-Clause": [
        "\n\n".join([_BSD_HEAD, _BSD_ONE, _BSD_TWO, _BSD_NONE]),
        "\n\n".join(["BSD 2-Clause License", _BSD_HEAD, _BSD_ONE, _BSD_TWO, _BSD_NONE])
    ],
    "BSD-3-Clause": [
        "\n\n".join([_BSD_HEAD, _BSD_ONE, _BSD_TWO, _BSD_THREE, _BSD_NONE]),
        "\n\n".join(["BSD 3-Clause License", _BSD_HEAD, _BSD_ONE, _BSD_TWO, _BSD_THREE, _BSD_NONE])
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_NONE,
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_NONE
    ],
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_NONE,
        "BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_NONE
    ],
    "Unlicense": [_UNLICENSE],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed under the Apache License, Version 2.0."
    ],
    "GPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
}
# Further one-liners. The SQL of `oracle` knows these and LICENSES, not the whole texts.
LINES: dict[str, list[str]] = {"GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3."]}
_END = "END OF TERMS AND CONDITIONS"


def whole_texts() -> dict[str, list[str]]:
    """The texts in license_texts/ by id (the file's name); those with an end mark also up to there."""
    out = {}
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out[path.stem] = [text, text[: text.index(_END)] + _END, text[: text.index(_END)]] if _END in text else [text]
    return out


def default_licenses() -> dict[str, list[str]]:
    """LICENSES, LINES and the whole texts."""
    out: dict[str, list[str]] = {}
    for part in (LICENSES, LINES, whole_texts()):
        for k, texts in part.items():
            out[k] = [*out.get(k, []), *texts]
    return out


def canonical(text: Column) -> Column:
    """The text as licences are compared, null if nothing is left."""
    out = F.lower(text.cast("string"))
    for pattern, put in RULES:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(put))
    return F.nullif(F.trim(out), F.lit(""))


def known(docs: DataFrame, licenses: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """license_id and canonical_digest of every known licence; of ids with an equal text the least."""
    texts_of = default_licenses() if licenses is None else licenses
    rows = docs.sparkSession.createDataFrame(
        [(k, t) for k, texts in texts_of.items() for t in texts], "license_id string, text string"
    )
    return rows.select(
        "license_id", F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("canonical_digest")
    ).groupBy("canonical_digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """doc_id, canonical_digest, license_id of every document; license_id is null unless the whole text is a known licence.

    licenses: the texts of each id; default_licenses() if None.
    """
    digests = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("canonical_digest")
    )
    return digests.join(
        F.broadcast(known(docs, licenses)), "canonical_digest", "left"
    ).select("doc_id", "canonical_digest", "license_id")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def told(text: str) -> str:
        out = f"lower({text})"
        for pattern, put in RULES:
            out = f"regexp_replace({out}, {quote(pattern)}, {quote(put)}, 'g')"
        return f"nullif(trim({out}), '')"

    rows = ", ".join(f"({quote(k)}, {quote(t)})" for part in (LICENSES, LINES) for k, texts in part.items() for t in texts)
    return f"""
        WITH k AS (SELECT sha256({told('t')}) AS canonical_digest, min(id) AS license_id FROM (VALUES {rows}) AS v(id, t) GROUP BY 1),
        d AS (SELECT doc_id, sha256({told('text')}) AS canonical_digest FROM documents)
        SELECT d.doc_id, d.canonical_digest, k.license_id FROM d LEFT JOIN k USING (canonical_digest)
    """
