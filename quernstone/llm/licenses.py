"""License notices: one-line forms, standard headers and whole texts.

The long whole texts are files in ``license_texts``, as their publishers give
them.  Numbers of list items and years, holders and addresses are left out of
the texts below, as copies differ in them.
"""

from __future__ import annotations

from functools import cache
from importlib.resources import files

#: What licenses are called in one-line notices.
CALLED = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License", "Apache Software License, Version 2.0"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache Software License, Version 1.1"],
    "MIT": ["MIT License", "MIT/X11 License", "Expat License"],
    "BSD": ["BSD License", "BSD-style License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "4-Clause BSD License", "Original BSD License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "MPL 1.1 License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "MPL 2.0 License"],
    "EPL-1.0": ["Eclipse Public License, Version 1.0", "Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License v2.0"],
    "CDDL-1.0": ["Common Development and Distribution License, Version 1.0", "CDDL 1.0 License"],
    "EUPL-1.2": ["European Union Public Licence, Version 1.2", "EUPL 1.2 Licence"],
    "Artistic-1.0": ["Artistic License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "PostgreSQL": ["PostgreSQL License"],
    "Unlicense": ["The Unlicense"],
    "WTFPL": ["Do What The Fuck You Want To Public License", "WTFPL License"],
    "CC0-1.0": ["Creative Commons CC0 1.0 Universal", "CC0 1.0 Universal", "Creative Commons Zero 1.0"],
}
#: The GNU licenses by name, in all versions.
GNU = {
    "GPL": ("General Public License", ["1.0", "2.0", "3.0"]),
    "LGPL": ("Lesser General Public License", ["2.1", "3.0"]),
    "AGPL": ("Affero General Public License", ["3.0"]),
    "GFDL": ("Free Documentation License", ["1.1", "1.2", "1.3"]),
}
for _short, (_long, _versions) in GNU.items():
    for _version in _versions:
        _v = _version.removesuffix(".0")
        CALLED[f"{_short}-{_version}"] = [f"GNU {_long}, version {_v}", f"GNU {_long} v{_v}", f"GNU {_short} version {_v}", f"{_short} version {_v}", f"{_short}v{_v}"]
CALLED["LGPL-2.0"] = ["GNU Library General Public License, version 2", "GNU Lesser General Public License, version 2"]
#: Creative Commons licenses by their elements, in all versions.
CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
#: Frames of one-line notices.
FRAMES = ["under the {}", "under the terms of the {}", "released under the {}", "licensed under the {}", "distributed under the {}", "license: {}"]
ID_FRAMES = ["SPDX-License-Identifier: {}"]

_GNU_HEADER = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {name} for more details."""
_GNU_SENTENCE = """free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {version} of the License, or (at your option) any later version"""
_GNU_ONLY = """free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {version} as published by
the Free Software Foundation"""

#: Standard headers of source files.
HEADERS = [
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("MPL-1.1", """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/
Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied.
See the License for the specific language governing rights and limitations under the License."""),
    ("BSD", """Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."""),
    ("MIT", """Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."""),
    ("BSL-1.0", """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
http://www.boost.org/LICENSE_1_0.txt)"""),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("EPL-1.0", """All rights reserved. This program and the accompanying materials are made available under the terms of the
Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"""),
    ("GFDL-1.3", """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License,
Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no
Back-Cover Texts."""),
    ("GFDL-1.2", """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License,
Version 1.2 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no
Back-Cover Texts."""),
]
for _name, _long, _version, _what in [
    ("GPL-2.0", "General Public License", "2", "program"),
    ("GPL-3.0", "General Public License", "3", "program"),
    ("LGPL-2.0", "Library General Public License", "2", "library"),
    ("LGPL-2.1", "Lesser General Public License", "2.1", "library"),
    ("LGPL-3.0", "Lesser General Public License", "3", "library"),
    ("AGPL-3.0", "Affero General Public License", "3", "program"),
]:
    HEADERS += [(_name, form.format(what=_what, name=_long, version=_version)) for form in (_GNU_HEADER, _GNU_SENTENCE, _GNU_ONLY)]

_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_1 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
_BSD_2 = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_4 = """All advertising materials mentioning features or use of this software must display the following acknowledgement:
This product includes software developed by the organization."""
_ISC_1 = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_2 = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_3 = """. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Whole texts that are short.
TEXTS = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", "\n".join([_BSD_1, _BSD_2, _AS_IS])),
    ("BSD-3-Clause", "\n".join([_BSD_1, _BSD_2, _BSD_3, _AS_IS])),
    ("BSD-4-Clause", "\n".join([_BSD_1, _BSD_2, _BSD_4, _BSD_3, _AS_IS])),
    ("ISC", _ISC_1 + _ISC_2 + _ISC_3),
    ("0BSD", _ISC_1 + _ISC_3),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and
to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,
unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
]


def _lines() -> list[tuple[str, str]]:
    out = []
    for name, forms in CALLED.items():
        out += [(name, frame.format(form.removeprefix("The "))) for form in forms for frame in FRAMES]
        out += [(name, frame.format(name)) for frame in ID_FRAMES]
        out += [(name, frame.format(name)) for frame in ("licensed under {}", "released under {}", "under the {} license")]
    for short, (long, versions) in GNU.items():
        # without a version
        out += [(short, frame.format(f"GNU {long}")) for frame in FRAMES]
        for version in versions:
            for end in ("-only", "-or-later"):
                out.append((f"{short}-{version}", f"SPDX-License-Identifier: {short}-{version}{end}"))
            v = version.removesuffix(".0")
            out += [(f"{short}-{version}", f"under the terms of version {v} of the GNU {long}")]
            out += [(f"{short}-{version}", f"{frame} {short}v{v}") for frame in ("licensed under", "released under")]
    for short, long in CC.items():
        for version in CC_VERSIONS:
            name = f"CC-{short}-{version}"
            for called in (f"CC {short} {version}", f"Creative Commons {long} {version}", f"Creative Commons {long} {version} International License"):
                out += [(name, f"licensed under {called}"), (name, f"under a {called}"), (name, f"under the {called}")]
            out += [(name, f"SPDX-License-Identifier: CC-{short}-{version}"), (name, f"creativecommons.org/licenses/{short.lower()}/{version}")]
    out.append(("CC0-1.0", "creativecommons.org/publicdomain/zero/1.0"))
    return out


@cache
def notices() -> tuple[tuple[str, str], ...]:
    """(name, notice) of all notices that come with this module, without repeats."""
    whole = [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")]
    return tuple(dict.fromkeys([*_lines(), *HEADERS, *TEXTS, *sorted(whole)]))
