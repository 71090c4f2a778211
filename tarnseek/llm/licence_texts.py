"""Known licences: their published texts and the notices that name them. Fixed values, in plain order.

Long texts, and those that are published in several wordings, are files of the folder known_licences: NAME_N.txt.
"""

from __future__ import annotations

import re
from importlib.resources import files

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
"""

ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
"""

BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""

_ADDRESS = re.compile(r"51 Franklin Street, Fifth Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA")
_ADDRESSES = ["59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA"]
_END = "END OF TERMS AND CONDITIONS"


def _wordings(text: str) -> list[str]:
    """A published text, without what follows its terms, with filled-in copyright lines, and with former addresses."""
    out = [text]
    if _END in text:
        terms = text[: text.index(_END)]
        out += [terms, terms + _END]
    out += [re.sub(r"Copyright [\[{]yyyy[\]}] [\[{]name of copyright owner[\]}]", "", t) for t in out]
    out += [t.replace("GNU Lesser General\nPublic License instead", "GNU Library General\nPublic License instead") for t in out]
    out += [_ADDRESS.sub(a, t) for t in out for a in _ADDRESSES]
    return list(dict.fromkeys(out))


def _filed() -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for f in sorted(files("tarnseek.llm").joinpath("known_licences").iterdir(), key=lambda f: f.name):
        if f.name.endswith(".txt"):
            found.setdefault(f.name.rpartition("_")[0], []).extend(_wordings(f.read_text(encoding="utf-8")))
    return found


#: Heading lines that may stand before a text; each makes a text of its own.
_HEADINGS: dict[str, list[str]] = {
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"],
    "ISC": ["ISC License", "The ISC License"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "Unlicense": ["The Unlicense"],
    "Zlib": ["zlib License", "The zlib License"],
}

_PLAIN: dict[str, list[str]] = {"0BSD": [ZERO_BSD], "BSD-2-Clause": [BSD_2], "ISC": [ISC], "MIT": [MIT], "Zlib": [ZLIB]} | _filed()

#: Whole licence texts by their usual short name. A heading line before the text makes a text of its own.
TEXTS: dict[str, list[str]] = {
    name: [*texts, *[f"{h}\n\n{t}" for h in _HEADINGS.get(name, []) for t in texts]] for name, texts in sorted(_PLAIN.items())
}

#: Names after SPDX-License-Identifier, where they aren't the short name alone.
_SPDX = {n: [f"{n}-only", f"{n}-or-later", n, f"{n}+"] for n in ("AGPL-3.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0")}

_SENTENCES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance',
        'to you under the Apache License, Version 2.0 (the',
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "all-rights-reserved": ["All rights reserved."],
}

#: One-line notices that put a text under a licence.
NOTICES: dict[str, list[str]] = {
    name: [*_SENTENCES.get(name, []), *[f"SPDX-License-Identifier: {i}" for i in _SPDX.get(name, [] if name == "all-rights-reserved" else [name])]]
    for name in sorted({*TEXTS, *_SENTENCES, *_SPDX})
}

#: Spellings that mean the same, after all but letters and digits have become single spaces.
EQUIVALENTS: list[tuple[str, str]] = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("behaviour", "behavior"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
]
