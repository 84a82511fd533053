import zlib

import pytest

from siltstone.sources import pdf
from siltstone.sources.errors import Refused


def make(pages, fonts=None, extra=(), flate=False, trailer=""):
    fonts = fonts or "/F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    objs = {1: "<< /Type /Catalog /Pages 2 0 R >>"}
    kids = []
    for i, c in enumerate(pages):
        body = c if isinstance(c, bytes) else c.encode("latin-1")
        head = ""
        if flate:
            body, head = zlib.compress(body), "/Filter /FlateDecode "
        objs[10 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >>"
        objs[11 + 2 * i] = f"<< {head}/Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream"
        kids.append(f"{10 + 2 * i} 0 R")
    objs[2] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} /Resources << /Font << {fonts} >> /XObject << /X 90 0 R >> >> >>"
    objs |= dict(extra)
    out = b"%PDF-1.5\n"
    for n, o in objs.items():
        out += f"{n} 0 obj\n".encode() + (o if isinstance(o, bytes) else o.encode("latin-1")) + b"\nendobj\n"
    return out + f"trailer << /Root 1 0 R {trailer} >>\nstartxref\n0\n%%EOF".encode()


@pytest.mark.parametrize("flate", [False, True])
def test_breaks(flate):
    page = "BT /F1 12 Tf 10 700 Td (Hello) Tj 40 0 Td (World) Tj 0 -14 Td (Next) Tj 1 0 Td (Glued) Tj T* (Star) Tj (Quote) ' [(A) -300 (B) -100 (C)] TJ ET"
    assert pdf.extract_text(make([page], flate=flate)) == "Hello World\nNextGlued\nStar\nQuoteA BC"


def test_matrix_pages_and_forms():
    form = (90, b"<< /Subtype /Form /Length 26 >>\nstream\nBT /F1 1 Tf (inner) Tj ET  \nendstream")
    one = "BT /F1 1 Tf 1 0 0 1 10 10 Tm (a) Tj 1 0 0 1 20 10 Tm (b) Tj 1 0 0 1 20 30 Tm (c) Tj ET /X Do BT (d) Tj ET"
    assert pdf.extract_text(make([one, "BT /F1 1 Tf (two \\(2\\) \\101) Tj ET", ""], extra=[form])) == "a b\nc\ninner\nd\x0ctwo (2) A\x0c"


def test_fonts():
    cmap = b"1 beginbfchar <01> <00480069> endbfchar 1 beginbfrange <0002> <0003> <0041> endbfrange"
    fonts = "/F1 << /Subtype /Type1 /Encoding << /Differences [65 /eacute /uni20AC /zero] >> >> /F2 << /Subtype /Type0 /ToUnicode 91 0 R >> /F3 << /Subtype /Type0 >>"
    extra = [(91, b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream")]
    assert pdf.extract_text(make(["BT /F1 1 Tf (ABC\\222) Tj /F2 1 Tf <01000200039999> Tj ET"], fonts, extra)) == "é€0’HiAB�"
    with pytest.raises(Refused, match="CID"):
        pdf.extract_text(make(["BT /F3 1 Tf <0001> Tj ET"], fonts, extra))


def test_refusals():
    for data, kind in ((b"no", "InvalidMagic"), (b"%PDF-1.4", "BadValue"), (make(["BT (x) Tj ET"], trailer="/Encrypt 5 0 R"), "Unsupported")):
        with pytest.raises(Refused) as e:
            pdf.extract_text(data)
        assert e.value.kind == kind


def test_object_streams():
    inner = b"1 0 2 34 << /Type /Catalog /Pages 2 0 R >>  << /Type /Pages /Kids [10 0 R] /Resources << /Font << /F1 << /Subtype /Type1 >> >> >> >>"
    first = inner.index(b"<<")
    second = inner.index(b"<< /Type /Pages") - first
    inner = inner.replace(b"1 0 2 34", b"1 0 2 %2d" % second)
    body = zlib.compress(inner)
    page = b"BT /F1 1 Tf (packed) Tj ET"
    data = b"%PDF-1.5\n" + b"5 0 obj\n<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (first, len(body)) + body + b"\nendstream\nendobj\n"
    data += b"10 0 obj << /Type /Page /Contents 11 0 R >> endobj\n11 0 obj << /Length %d >>\nstream\n" % len(page) + page + b"\nendstream endobj\n"
    data += b"6 0 obj << /Type /XRef /Root 1 0 R /Length 0 >>\nstream\n\nendstream endobj\n%%EOF"
    assert pdf.extract_text(data) == "packed"
