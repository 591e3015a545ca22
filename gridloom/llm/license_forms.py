"""Wordings of licences: whole texts, notices and usual short names."""

from __future__ import annotations

import pkgutil

#: Whole texts, by the file in license_texts/.
FILES = {
    "apache-2.0": "Apache-2.0",
    "cc0-1.0": "CC0-1.0",
    "gfdl-1.3": "GFDL-1.3",
    "gpl-1.0": "GPL-1",
    "gpl-2.0": "GPL-2",
    "gpl-3.0": "GPL-3",
    "lgpl-2.1": "LGPL-2.1",
    "lgpl-3.0": "LGPL-3",
    "mpl-2.0": "MPL-2.0",
}
SHOUTED = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TWO_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
MIT = f"""{GRANT} and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
SHORT = {
    "all-rights-reserved": ["All rights reserved", "All rights are reserved", "Alle Rechte vorbehalten", "Tous droits réservés", "Todos los derechos reservados"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache License v2", "Apache License v2.0", "Apache-2.0", "Apache 2 license", "Apache Software License 2.0", "Apache Software License, Version 2.0", "apache.org/licenses/LICENSE-2.0"],
    "bsd-2-clause": [f"{TWO_CLAUSES} {SHOUTED}", "BSD 2-Clause", "2-clause BSD", "Simplified BSD License", "FreeBSD License", "two-clause BSD"],
    "bsd-3-clause": [f"{TWO_CLAUSES} {THIRD} {SHOUTED}", "BSD 3-Clause", "3-clause BSD", "New BSD License", "Modified BSD License", "Revised BSD License", "three-clause BSD"],
    "bsd": ["BSD License", "BSD licensed", "BSD-style license", "licensed under BSD"],
    "cc0-1.0": ["CC0 1.0", "CC0 1.0 Universal Public Domain Dedication", "creativecommons.org/publicdomain/zero/1.0"],
    "isc": [ISC, "ISC License", "ISC licensed", "SPDX-License-Identifier: ISC"],
    "mit": [MIT, GRANT, "MIT License", "MIT licensed", "MIT licence", "licensed under MIT", "released under MIT", "SPDX-License-Identifier: MIT", "opensource.org/licenses/MIT"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL v2.0"],
}
#: Short name, middle words of the long one, versions.
GNU = [
    ("gpl", "General", ("1.0", "2.0", "3.0")),
    ("lgpl", "Lesser General", ("2.0", "2.1", "3.0")),
    ("lgpl", "Library General", ("2.0",)),
    ("agpl", "Affero General", ("1.0", "3.0")),
]
CC = {
    "by": "Attribution",
    "by-sa": "Attribution-ShareAlike",
    "by-nc": "Attribution-NonCommercial",
    "by-nd": "Attribution-NoDerivatives",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}


def gnu() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for short, middle, versions in GNU:
        name = f"GNU {middle} Public License"
        out.setdefault(short, []).extend([name, f"GNU {short}", f"under the {short}", f"licensed under {short}"])
        for v in versions:
            forms = out.setdefault(f"{short}-{v}", [])
            for n in dict.fromkeys((v, v.removesuffix(".0"))):
                forms += [f"This work is licensed under the {name}, version {n}.", f"{name}, version {n}", f"{name} v{n}", f"{name} {n}"]
                forms += [f"{short} version {n}", f"{short} v{n}", f"{short} {n}", f"{short}v{n}"]
                forms += [f"under the terms of the {name} as published by the Free Software Foundation; either version {n} of the License, or (at your option) any later version", f"under the terms of the {name} as published by the Free Software Foundation, version {n}", f"under the terms of the {name} version {n} as published by the Free Software Foundation"]
    return out


def creative_commons() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for code, name in CC.items():
        spaced = name.replace("NonCommercial", "Non-Commercial").replace("ShareAlike", "Share-Alike").replace("NoDerivatives", "NoDerivs")
        names = dict.fromkeys((name, spaced))
        out[f"cc-{code}"] = [f"CC {code} license", f"CC {code} licence", f"under CC {code}", f"under a CC {code}", *[f"Creative Commons {n} License" for n in names]]
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            forms = [f"CC {code} {v}", f"creativecommons.org/licenses/{code}/{v}"]
            for n in names:
                forms += [f"Creative Commons {n} {v}", f"This work is licensed under a Creative Commons {n} {v} International License.", f"Creative Commons {n} License {v}", f"Creative Commons {n} {v} Unported License"]
            out[f"cc-{code}-{v}"] = forms
    return out


def forms() -> dict[str, tuple[str, ...]]:
    """The wordings of each licence."""
    out: dict[str, list[str]] = {}
    for group in (SHORT, gnu(), creative_commons()):
        for name, texts in group.items():
            out.setdefault(name, []).extend(texts)
    for name, file in FILES.items():
        out.setdefault(name, []).append((pkgutil.get_data(__package__, f"license_texts/{file}") or b"").decode())
    return {name: tuple(dict.fromkeys(texts)) for name, texts in out.items()}
