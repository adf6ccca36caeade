"""Plain text as a paged PDF in a standard font: the executive report."""

from __future__ import annotations

import textwrap
from pathlib import Path

LINES, WIDTH = 58, 92  # of a page


def write_pdf(path: str | Path, text: str) -> None:
    """``text`` line by line; lines that begin with # are set larger. Signs outside Latin-1 become question marks."""
    lines = [(part, line.startswith("#")) for line in text.split("\n") for part in (textwrap.wrap(line.lstrip("# "), WIDTH) or [""])]
    pages = [lines[i : i + LINES] for i in range(0, len(lines), LINES)] or [[]]
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "", "<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Courier-Bold /Encoding /WinAnsiEncoding >>"]
    kids = []
    for page in pages:
        shown = []
        for line, head in page:
            for a, b in (("\\", "\\\\"), ("(", "\\("), (")", "\\)")):
                line = line.replace(a, b)
            shown.append(f"/F{2 if head else 1} {11 if head else 9} Tf ({line}) Tj T*")
        stream = "BT 13 TL 50 790 Td " + " ".join(shown) + " ET"
        objects.append(f"<< /Length {len(stream.encode('latin-1', 'replace'))} >>\nstream\n{stream}\nendstream")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents {len(objects)} 0 R >>")
        kids.append(f"{len(objects)} 0 R")
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(kids)}] >>"
    out, places = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n{body}\nendobj\n".encode("latin-1", "replace")
    table = "".join(f"{at:010d} 00000 n \n" for at in places)
    tail = f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n"
    Path(path).write_bytes(out + tail.encode())
