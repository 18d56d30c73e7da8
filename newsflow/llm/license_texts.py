"""Templates of the registered licence scan: one-line notices, whole licence texts (licenses/*.txt), titles and usual headers.

Names are SPDX identifiers; what follows a '#' tells templates of one licence apart and is not reported.
"""

from __future__ import annotations

from pathlib import Path

from .license_scan import TEMPLATES

_GPL = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version."
_LGPL = "This library is free software{0} you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
#: Titles, headers and single sentences by SPDX identifier.
HEADERS = {
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "BSD-3-Clause": [_BSD],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _GPL.format(";", ";", 2)],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GPL.format(":", ",", 3)],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", _LGPL.format(";", ";", 2.1)],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _LGPL.format(":", ",", 3)],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}


def templates() -> dict[str, str]:
    """All templates by name; the texts are read on the driver."""
    whole = {f"{p.stem}#text": p.read_text("utf-8") for p in Path(__file__).with_name("licenses").glob("*.txt")}
    return TEMPLATES | whole | {f"{name}#header{k}": t for name, texts in HEADERS.items() for k, t in enumerate(texts)}
