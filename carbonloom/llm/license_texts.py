"""Public license notices, by name. The wordings that the licenses' publishers give."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(what: str, name: str, version: str) -> str:
    return f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


#: Short notices, opening sentences and full texts.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": _gnu("program", "Affero General Public License", "3"),
    "AGPL-3.0-terms": "under the terms of the AGPL v3",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-2-Clause-full": _BSD + _BSD_DISCLAIMER,
    "BSD-3-Clause-full": _BSD + _BSD_NAMES + _BSD_DISCLAIMER,
    "BSL-1.0-header": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-bare": "CC BY 4.0",
    "CC-BY-4.0-name": "Creative Commons Attribution 4.0 International License",
    "CC-BY-4.0-page": "creativecommons.org/licenses/by/4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-bare": "CC BY-NC 4.0",
    "CC-BY-NC-4.0-name": "Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-NC-4.0-page": "creativecommons.org/licenses/by-nc/4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-bare": "CC BY-SA 4.0",
    "CC-BY-SA-4.0-name": "Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-SA-4.0-page": "creativecommons.org/licenses/by-sa/4.0",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "CC0-1.0-bare": "CC0 1.0",
    "CC0-1.0-name": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": _gnu("program", "General Public License", "2"),
    "GPL-2.0-terms": "under the terms of the GPL v2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": _gnu("program", "General Public License", "3"),
    "GPL-3.0-terms": "under the terms of the GPL v3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "ISC-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1-header": _gnu("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": _gnu("library", "Lesser General Public License", "3"),
    "LGPL-3.0-terms": "under the terms of the LGPL v3",
    "MIT": "Released under the MIT License.",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-terms": "Licensed under the MIT license",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense-header": "This is free and unencumbered software released into the public domain.",
    "Zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "reserved": "All rights reserved.",
}

#: Titles and names as they stand above full texts, in readme files and in mentions.
TEMPLATES |= {
    "AGPL-3.0-name": "GNU Affero General Public License Version 3",
    "Apache-2.0-title": "Apache License Version 2.0, January 2004",
    "Artistic-2.0-name": "The Artistic License 2.0",
    "BSD-2-Clause-name": "BSD 2-Clause License",
    "BSD-3-Clause-name": "BSD 3-Clause License",
    "CC-BY-3.0-bare": "CC BY 3.0",
    "CC-BY-3.0-name": "Creative Commons Attribution 3.0",
    "CC-BY-4.0-id": "CC-BY-4.0",
    "CC-BY-SA-3.0-bare": "CC BY-SA 3.0",
    "CC-BY-SA-3.0-name": "Creative Commons Attribution-ShareAlike 3.0",
    "CC-BY-SA-4.0-id": "CC-BY-SA-4.0",
    "EPL-1.0-name": "Eclipse Public License - v 1.0",
    "EPL-2.0-name": "Eclipse Public License - v 2.0",
    "GFDL-1.2-name": "GNU Free Documentation License, Version 1.2",
    "GFDL-1.3-name": "GNU Free Documentation License, Version 1.3",
    "GPL-2.0-name": "GNU General Public License Version 2",
    "GPL-2.0-or-later-name": "GPLv2 or later",
    "GPL-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0-name": "GNU General Public License Version 3",
    "GPL-3.0-or-later-name": "GPLv3 or later",
    "GPL-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0-name": "GNU Lesser General Public License Version 3",
    "MIT-name": "MIT License",
}

#: Identifiers of the SPDX list, for its one-line form and for the further parts of an expression.
_SPDX = "AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 EPL-1.0 EPL-2.0 GFDL-1.3-only GFDL-1.3-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib"
TEMPLATES |= {f"{x}-spdx": f"SPDX-License-Identifier: {x}" for x in _SPDX.split()}
TEMPLATES |= {f"{x}-spdx-{w.lower()}": f"{w} {x}" for x in _SPDX.split() if any(c.isdigit() for c in x) for w in ("OR", "AND")}
TEMPLATES["Apache-2.0-or-MIT-spdx"] = "SPDX-License-Identifier: Apache-2.0 OR MIT"
