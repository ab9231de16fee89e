"""Templates of public licenses: notices of their texts, and the lines that name them.

A template is (label, text, required words). The required words tell it from
templates that differ in them alone; a copy that lacks them is not verified.
"""

from __future__ import annotations

# The creative-commons licenses, by code and by name.
CREATIVE_COMMONS = {
    "by": "Attribution",
    "by-sa": "Attribution-ShareAlike",
    "by-nd": "Attribution-NoDerivatives",
    "by-nc": "Attribution-NonCommercial",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}

# Label, names of three words or more, identifiers.
NAMED = [
    ("mit", ["Released under the MIT License", "Expat MIT License"], ["MIT"]),
    ("apache", ["Licensed under the Apache License, Version 2.0", "Apache Software License 2.0"], ["Apache-2.0", "Apache-1.1"]),
    ("gpl", ["GNU General Public License, version 2", "GNU General Public License, version 3", "GNU GPL v2", "GNU GPL v3"], ["GPL-2.0", "GPL-3.0"]),
    ("lgpl", ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL v2", "GNU LGPL v3"], ["LGPL-2.0", "LGPL-2.1", "LGPL-3.0"]),
    ("agpl", ["GNU Affero General Public License"], ["AGPL-3.0"]),
    ("gfdl", ["GNU Free Documentation License"], ["GFDL-1.3"]),
    ("bsd", ["BSD 2-Clause License", "BSD 3-Clause License", "BSD 4-Clause License", "Simplified BSD License", "Modified BSD License", "New BSD License"], ["BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD"]),
    ("mpl", ["Mozilla Public License", "Mozilla Public License, v. 2.0"], ["MPL-1.1", "MPL-2.0"]),
    ("epl", ["Eclipse Public License", "Eclipse Public License - v 2.0"], ["EPL-1.0", "EPL-2.0"]),
    ("eupl", ["European Union Public Licence"], ["EUPL-1.1", "EUPL-1.2"]),
    ("cddl", ["Common Development and Distribution License"], ["CDDL-1.0", "CDDL-1.1"]),
    ("cpl", ["Common Public License"], ["CPL-1.0"]),
    ("cpal", ["Common Public Attribution License"], ["CPAL-1.0"]),
    ("apsl", ["Apple Public Source License"], ["APSL-2.0"]),
    ("afl", ["Academic Free License"], ["AFL-3.0"]),
    ("osl", ["Open Software License"], ["OSL-3.0"]),
    ("artistic", ["Artistic License 2.0", "The Artistic License"], ["Artistic-1.0", "Artistic-2.0"]),
    ("isc", ["Internet Systems Consortium License", "The ISC License"], ["ISC"]),
    ("zlib", ["The zlib License", "zlib/libpng License"], ["Zlib"]),
    ("boost", ["Boost Software License"], ["BSL-1.0"]),
    ("ms-pl", ["Microsoft Public License"], ["MS-PL"]),
    ("ms-rl", ["Microsoft Reciprocal License"], ["MS-RL"]),
    ("ncsa", ["University of Illinois/NCSA Open Source License"], ["NCSA"]),
    ("postgresql", ["The PostgreSQL License"], ["PostgreSQL"]),
    ("python", ["Python Software Foundation License"], ["PSF-2.0", "Python-2.0"]),
    ("php", ["The PHP License", "PHP License, version 3.01"], ["PHP-3.01"]),
    ("ruby", ["Ruby's License Terms"], ["Ruby"]),
    ("openssl", ["OpenSSL and SSLeay Licenses", "The OpenSSL License"], ["OpenSSL"]),
    ("ofl", ["SIL Open Font License"], ["OFL-1.1"]),
    ("odbl", ["Open Database License", "Open Data Commons Open Database License"], ["ODbL-1.0"]),
    ("odc-by", ["Open Data Commons Attribution License"], ["ODC-By-1.0"]),
    ("pddl", ["Public Domain Dedication and License"], ["PDDL-1.0"]),
    ("cc0", ["CC0 1.0 Universal", "CC0 Public Domain Dedication"], ["CC0-1.0"]),
    ("unlicense", ["free and unencumbered software released into the public domain"], ["Unlicense"]),
    ("wtfpl", ["Do What The Fuck You Want To Public License"], ["WTFPL"]),
    ("cecill", ["CeCILL Free Software License"], ["CECILL-2.1", "CECILL-B", "CECILL-C"]),
    ("upl", ["Universal Permissive License"], ["UPL-1.0"]),
    ("mulan", ["Mulan Permissive Software License"], ["MulanPSL-2.0"]),
    ("w3c", ["W3C Software Notice and License"], ["W3C"]),
    ("zpl", ["Zope Public License"], ["ZPL-2.1"]),
    ("vim", ["The Vim License"], ["Vim"]),
    ("sleepycat", ["The Sleepycat License"], ["Sleepycat"]),
    ("bluoak", ["Blue Oak Model License"], ["BlueOak-1.0.0"]),
    ("sspl", ["Server Side Public License"], ["SSPL-1.0"]),
    ("busl", ["Business Source License"], ["BUSL-1.1"]),
    ("elastic", ["Elastic License 2.0"], ["Elastic-2.0"]),
    ("rail", ["Open RAIL-M License", "BigScience OpenRAIL-M License", "BigScience RAIL License"], ["OpenRAIL"]),
    ("all-rights-reserved", ["All rights reserved"], []),
]

# Notices and operative clauses of the license texts.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "under the Apache License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "Lesser General Public License"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Affero General Public License"),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.", "Free Documentation License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "source and binary forms"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Eclipse Public License"),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.", "Common Development and Distribution License"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "alter it and redistribute it freely"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", "person or organization obtaining"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "free and unencumbered software"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived all copyright"),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ", "Open Font License"),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.", "without a written agreement"),
    ("artistic", "This package is free software; you may redistribute it and/or modify it under the same terms as Perl itself", "same terms as Perl itself"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", "changing it is allowed"),
]


def templates() -> list[tuple[str, str, str]]:
    """All templates, from the lists and, for families and identifiers, from rules."""
    out = list(NOTICES)
    for label, names, ids in NAMED:
        out += [(label, name, name) for name in names]
        out += [(label, f"SPDX-License-Identifier: {i}", f"License-Identifier: {i}") for i in ids]
    for code, name in CREATIVE_COMMONS.items():
        label = f"cc-{code}"
        for version, kind in VERSIONS.items():
            out.append((label, f"licensed under a Creative Commons {name} {version} {kind} License", f"Commons {name} {version}"))
            out.append((label, f"CC {code} {version}", f"CC {code} {version}"))
            out.append((label, f"SPDX-License-Identifier: CC-{code}-{version}", f"License-Identifier: CC-{code}-{version}"))
        out.append((label, f"Creative Commons {name} License", f"Commons {name} License"))
    return out
