"""Licenses that are looked for: whole texts, the headers by which files refer to them, and
line notices made of phrases and names. The texts stand in ``license_files``.

Whole texts are the published ones, word for word. AGPL, EPL and the Creative Commons licenses
other than CC0 are known by headers and line notices alone.
"""

from __future__ import annotations

from importlib.resources import files

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: str, what: str = "program") -> str:
    return (
        f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} "
        f"as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
    )


#: Notices that stand in for a license, and the conditions of short ones.
HEADERS: dict[str, str | tuple[str, ...]] = {
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "BSD-2-Clause": f"{_BSD_TERMS} {_BSD_WARRANTY}",
    "BSD-3-Clause": f"{_BSD_TERMS} {_BSD_THIRD} {_BSD_WARRANTY}",
    # The holder's name, which differs, is left out.
    "BSD third condition": _BSD_THIRD[_BSD_THIRD.index("nor the names") :],
    "BSD warranty": _BSD_WARRANTY,
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    ),
    "GPL-2.0 header": _gnu("General Public License", "2"),
    "GPL-3.0 header": _gnu("General Public License", "3"),
    "LGPL-2.1 header": (_gnu("Lesser General Public License", "2.1", "library"), _gnu("Library General Public License", "2", "library")),
    "LGPL-3.0 header": (_gnu("Lesser General Public License", "3"), _gnu("Lesser General Public License", "3", "library")),
    "MIT text": f"{_MIT} {_WARRANTY}",
    "MIT warranty": _WARRANTY,
}

#: Names of licenses as line notices have them.
NAMES: dict[str, tuple[str, ...]] = {
    "AGPL": ("GNU Affero General Public License", "Affero General Public License", "GNU AGPL", "AGPL v3", "AGPLv3", "AGPL 3.0"),
    "Apache-2.0": ("Apache License", "Apache License Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache 2 license"),
    "Artistic": ("Artistic License", "Artistic License 2.0"),
    "BSD": ("BSD License", "BSD 2-Clause", "BSD 3-Clause", "2-Clause BSD License", "3-Clause BSD License", "New BSD License", "Simplified BSD License"),
    "BSL-1.0": ("Boost Software License",),
    "EPL": ("Eclipse Public License", "EPL 1.0", "EPL 2.0", "EPL v2.0"),
    "GFDL": ("GNU Free Documentation License", "GFDL 1.2", "GFDL 1.3"),
    "GPL": ("GNU General Public License", "GNU GPL", "GPL v2", "GPL v3", "GPLv2", "GPLv3", "GPL 2.0", "GPL 3.0"),
    "ISC": ("ISC License",),
    "LGPL": ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL v2.1", "LGPL v3", "LGPLv2.1", "LGPLv3", "LGPL 2.1", "LGPL 3.0"),
    "MIT": ("MIT License", "Expat License", "MIT X11 License"),
    "MPL": ("Mozilla Public License", "MPL 1.1", "MPL 2.0", "MPL v2.0"),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("WTFPL", "Do What The Fuck You Want To Public License"),
    "Zlib": ("zlib License",),
    "CC0": ("CC0", "Creative Commons Zero", "CC0 1.0 Universal"),
}
_COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
for _short, _long in _COMMONS.items():
    _of = [f"CC {_short} {v}" for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]
    NAMES[f"CC-{_short}"] = (*_of, f"Creative Commons {_long} License", *(f"Creative Commons {_long} {v}" for v in ("2.0", "2.5", "3.0", "4.0")))

#: What stands before a name. Whatever precedes it (licensed, released, available, ...) may differ.
PHRASES = ("under", "under the", "under a", "under an", "under the terms of the", "subject to the", "subject to the terms of the", "governed by the")


def _lines(names: tuple[str, ...]) -> tuple[str, ...]:
    british = [n.replace("License", "Licence") for n in names if "License" in n]
    return tuple(f"{phrase} {name}" for phrase in PHRASES for name in (*names, *british))


#: Names are those that a match is given; any text of a name stands for it.
LINES: dict[str, str | tuple[str, ...]] = {f"{name} line": _lines(forms) for name, forms in NAMES.items()} | {
    "all rights reserved": "All rights reserved"
}

#: Whole texts, one to a file of ``license_files``, word for word.
TEXTS: dict[str, str] = {
    f"{file.name.removesuffix('.txt')} text": file.read_text(encoding="utf-8")
    for file in sorted(files(__package__).joinpath("license_files").iterdir(), key=lambda f: f.name)
}

ALL: dict[str, str | tuple[str, ...]] = HEADERS | LINES | TEXTS
