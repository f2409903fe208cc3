"""The license, notice and identifier texts that license scans look for, as (license, form, text)."""

from __future__ import annotations

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
    "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
    "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_GNU_NOTICE = "This {work} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted "
    "to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software "
    "must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
    "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
    "compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
    "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
)

# GNU licenses: id, name, versions as they are written.
_GNU = [
    ("GPL-2.0", "General Public License", "2"),
    ("GPL-3.0", "General Public License", "3"),
    ("LGPL-2.1", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "Lesser General Public License", "3"),
    ("AGPL-3.0", "Affero General Public License", "3"),
]
# Creative Commons licenses: short and long names of their parts, in every combination that exists.
_CC_PARTS = {"NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
_CC = [[], ["SA"], ["ND"], ["NC"], ["NC", "SA"], ["NC", "ND"]]
_SPDX = ["MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Apache-2.0", "MPL-2.0", "EPL-2.0", "CC0-1.0", "Unlicense", "WTFPL"]
_SPDX_GNU = ["", "-only", "-or-later"]
_NAMED = [("Apache-2.0", "Apache License, Version 2.0"), ("MPL-2.0", "Mozilla Public License, Version 2.0"), ("EPL-2.0", "Eclipse Public License, Version 2.0"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License")]


def _cc(parts: list[str]) -> list[tuple[str, str, str]]:
    name = "-".join(["CC-BY", *parts, "4.0"])
    long = "-".join(["Attribution", *(_CC_PARTS[p] for p in parts)])
    return [
        (name, "line", f"Licensed under CC {'-'.join(['BY', *parts])} 4.0."),
        (name, "line", f"This work is licensed under a Creative Commons {long} 4.0 International License."),
        (name, "identifier", f"SPDX-License-Identifier: {name}"),
    ]


def _gnu(name: str, long: str, version: str) -> list[tuple[str, str, str]]:
    new = version == "3"
    work = "library" if name.startswith("LGPL-2") else "program"
    return [
        (name, "line", f"This work is licensed under the GNU {long}, version {version}."),
        (name, "notice", _GNU_NOTICE.format(work=work, stop=":" if new else ";", comma="," if new else ";", name=long, version=version)),
        *((name, "identifier", f"SPDX-License-Identifier: {name}{end}") for end in _SPDX_GNU),
    ]


TEMPLATES = [
    ("MIT", "line", "Released under the MIT License."),
    ("MIT", "line", "This project is licensed under the terms of the MIT license."),
    ("MIT", "grant", _MIT_GRANT),
    ("MIT", "text", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    ("ISC", "grant", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "text", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.{_ISC_WARRANTY}"),
    ("0BSD", "text", f"{_ISC}.{_ISC_WARRANTY}"),
    ("BSD-2-Clause", "grant", _BSD_2),
    ("BSD-3-Clause", "grant", _BSD_2 + _BSD_3),
    ("BSD-2-Clause", "text", _BSD_2 + _BSD_WARRANTY),
    ("BSD-3-Clause", "text", _BSD_2 + _BSD_3 + _BSD_WARRANTY),
    ("Zlib", "text", _ZLIB),
    ("BSL-1.0", "grant", _BOOST),
    ("Apache-2.0", "notice", _APACHE),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "line", "This work is marked with CC0 1.0 Universal."),
    ("Unlicense", "grant", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "text", _UNLICENSE),
    ("WTFPL", "line", "Do What The Fuck You Want To Public License"),
    *((name, "line", f"Licensed under the {long}.") for name, long in _NAMED),
    *((name, "line", f"Released under the {long}.") for name, long in _NAMED),
    *(t for g in _GNU for t in _gnu(*g)),
    *(t for parts in _CC for t in _cc(parts)),
    *((name, "identifier", f"SPDX-License-Identifier: {name}") for name in _SPDX),
]
#: Words that tell one license from another: they must be matched, and none may stand among the words of a place unless the template has it.
TELLING = frozenset("mit bsd isc apache mozilla eclipse boost gnu lesser library affero cc cc0 by nc nd sa attribution noncommercial noderivatives noderivs sharealike only later clause".split())
#: Words that deny a license if they stand just before a line that names it.
DENYING = frozenset("not never no isn aren wasn nor cannot without neither unlike".split())
