"""Training paragraphs of the license classifier.

Fixed values: notices and characteristic passages of public licenses, by family, names and identifiers of licenses, forms in
which a name stands in a notice, and paragraphs that speak of licenses, permission or rights without granting any.
"""

NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
        "Licensed under the BSD 3-Clause License.",
        "Released under the 2-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Content is available under CC BY 3.0.",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "Released under the CC0 1.0 license.",
    ),
    "CC-BY-ND": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "This notice may not be removed or altered from any source distribution.",
    ),
    "BSL": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
        "Distributed under the Boost Software License, Version 1.0.",
        "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "For more information, please refer to http://unlicense.org",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0.",
    ),
    "OFL": (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "This license is available with a FAQ at https://scripts.sil.org/OFL",
    ),
    "Artistic": (
        "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    ),
    "WTFPL": (
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
        "Do What The Fuck You Want To Public License, Version 2.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced, stored or transmitted in any form without the prior written permission of the publisher.",
        "This material is confidential and proprietary; unauthorized copying is strictly prohibited.",
    ),
}

#: Names and identifiers, by family.
NAMES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "Apache-2.0": (("Apache License, Version 2.0", "Apache 2.0 License", "Apache License 2.0"), ("Apache-2.0",)),
    "MIT": (("MIT License",), ("MIT", "MIT-0")),
    "BSD": (("BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "New BSD License", "3-clause BSD License"), ("BSD-3-Clause", "BSD-2-Clause", "0BSD")),
    "GPL": (
        ("GNU General Public License, version 3", "GNU General Public License, version 2", "GNU General Public License v3.0", "GNU General Public License v2.0", "GNU GPL v3", "GNU GPL v2", "GPLv3", "GPLv2"),
        ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0", "GPL-3.0"),
    ),
    "LGPL": (("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3", "LGPLv2.1"), ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later")),
    "AGPL": (("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"), ("AGPL-3.0-only", "AGPL-3.0-or-later")),
    "MPL": (("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"), ("MPL-2.0", "MPL-1.1")),
    "ISC": (("ISC License",), ("ISC",)),
    "CC-BY": (("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC BY 3.0", "CC BY 2.0"), ("CC-BY-4.0", "CC-BY-3.0")),
    "CC-BY-SA": (("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0"), ("CC-BY-SA-4.0", "CC-BY-SA-3.0")),
    "CC-BY-NC": (("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC 3.0", "CC BY-NC-SA 4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0")),
    "CC-BY-ND": (("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC BY-NC-ND 4.0"), ("CC-BY-ND-4.0", "CC-BY-NC-ND-4.0")),
    "CC0": (("CC0 1.0 Universal", "CC0 1.0 license"), ("CC0-1.0",)),
    "Zlib": (("zlib License", "zlib/libpng License"), ("Zlib",)),
    "BSL": (("Boost Software License, Version 1.0", "Boost Software License 1.0"), ("BSL-1.0",)),
    "Unlicense": (("Unlicense",), ("Unlicense",)),
    "EPL": (("Eclipse Public License 2.0", "Eclipse Public License v1.0"), ("EPL-2.0", "EPL-1.0")),
    "OFL": (("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"), ("OFL-1.1",)),
    "Artistic": (("Artistic License 2.0",), ("Artistic-2.0", "Artistic-1.0")),
    "WTFPL": (("WTFPL",), ("WTFPL",)),
}

FORMS: tuple[str, ...] = ("Released under the {}.", "Licensed under the {}.", "Distributed under the {}.", "This project is licensed under the terms of the {}.", "Available under {}.")

#: All training notices of a family: those written out, then each name in each form, then its identifiers.
FAMILIES: dict[str, tuple[str, ...]] = {
    family: tuple(dict.fromkeys([*notices, *(f.format(n) for n in NAMES.get(family, ((), ()))[0] for f in FORMS), *(f"SPDX-License-Identifier: {i}" for i in NAMES.get(family, ((), ()))[1])]))
    for family, notices in NOTICES.items()
}

#: Words of everyday prose, which tell little about licenses.
EVERYDAY = frozenset(
    "all also along alter available can charge claim code commercial copies copy deal derived do document domain express files following form free freely general held "
    "however http including information into just law list made may must name new only open or origin other out part person place plainly portions project public purpose "
    "read same see sell several software some source such than their them there they through time under up use used want we what when which who without work written "
    "above anyone author authors being either event has have itself mit more names original prior released subject 0 1.0 2.0 3.0 4.0 version org www".split()
)

UNKNOWN: tuple[str, ...] = (
    "The driver showed the officer a licence and the number plate of the car.",
    "Permission denied while reading the file, ask the owner of the folder for access.",
    "The general public was invited to the opening of the software museum.",
    "The council said the license fee would rise next year for every household.",
    "Apache helicopters were seen above the valley in the early morning.",
    "The version of the story that you may have read in the papers is not true.",
    "All rights of the workers were discussed under the terms of the new contract.",
    "You may obtain a copy of the report at the front desk of the library.",
    "The above list of conditions was read to the members of the club.",
    "She studied at MIT and wrote software for small boats.",
    "The creative commons room is open to members from nine to five.",
    "See the manual for the specific language settings of this device.",
    "The work was released in the spring and sold in every shop.",
    "A free copy of the paper was given to any person who asked for it.",
    "The foundation published a letter to the public about free software.",
    "The source code of the program was lost in the fire.",
    "He was licensed to sell wine, beer and spirits in the village.",
    "Version 2 of the map shows the new road under the bridge.",
)
