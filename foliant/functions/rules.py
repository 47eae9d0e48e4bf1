"""Weighted patterns of the classifier, section keywords, routing markers, progress lines and number words."""

from __future__ import annotations

# Fixed values: (pattern on upper-cased text, weight), in the order in which evidence is listed.
INVOICE_RULES = [
    (r"\bTAX\s+INVOICE\b", 5),
    (r"\bINVOICE\b", 4),
    (r"\bINVOICE\s+(?:NO|NUMBER|DATE|DETAILS)\b", 4),
    (r"\bBILLING\s+ADDRESS\b", 2),
    (r"\bSHIPPING\s+ADDRESS\b", 2),
    (r"\bORDER\s+(?:NO|NUMBER|ID|DATE)\b", 3),
    (r"\bGST(?:IN)?\b", 2),
    (r"\bGST\s+REGISTRATION\b", 3),
    (r"\bHSN\b", 2),
    (r"\bSAC\b", 2),
    (r"\bPLACE\s+OF\s+(?:SUPPLY|DELIVERY)\b", 3),
    (r"\bAMOUNT\s+IN\s+WORDS\b", 3),
    (r"\bREVERSE\s+CHARGE\b", 2),
    (r"\bTOTAL\b", 1),
]
RECEIPT_RULES = [
    (r"\bRECEIPT\b", 4),
    (r"\bCASH\s+RECEIPT\b", 5),
    (r"\bCASH\s+MEMO\b", 4),
    (r"\bSUBTOTAL\b", 2),
    (r"\bCHANGE\b", 2),
    (r"\bTENDER\b", 2),
    (r"\bPAYMENT\s+METHOD\b", 2),
    (r"\bMODE\s+OF\s+PAYMENT\b", 2),
    (r"\bQTY\b", 1),
    (r"\bQUANTITY\b", 1),
    (r"\bTOTAL\b", 1),
]
GENERAL_RULES = [
    (r"\bNAME\b", 1),
    (r"\bADDRESS\b", 1),
    (r"\bPHONE\b", 1),
    (r"\bEMAIL\b", 1),
    (r"\bDATE\s+OF\s+BIRTH\b", 2),
    (r"\bDESCRIPTION\b", 1),
    (r"\bREFERENCE\b", 1),
]
CLASSES = {"INVOICE": INVOICE_RULES, "RECEIPT": RECEIPT_RULES, "GENERAL_DOCUMENT": GENERAL_RULES}

# Fixed values: (score at least, lead at least, confidence), the first that holds; otherwise 55.
CONFIDENCE = [(12, 5, 95), (9, 4, 90), (6, 3, 80), (4, 2, 70)]

# Section -> keywords of lower-cased text, in order of precedence. TOTAL is a pattern.
SECTIONS = [
    ("SELLER", ["sold by", "seller address", "seller name"]),
    ("SELLER_TAX", ["pan no", "pan number", "gst registration", "gstin", "gst no"]),
    ("BILLING", ["billing address", "bill to", "billed to"]),
    ("SHIPPING", ["shipping address", "ship to", "shipped to", "delivery address"]),
    ("SUPPLY_DELIVERY", ["place of supply", "place of delivery"]),
    ("ORDER", ["order number", "order no", "order date"]),
    ("INVOICE_DETAILS", ["invoice number", "invoice no", "invoice details", "invoice date"]),
    ("PRODUCT_TABLE", ["description", "unit price", "net amount", "tax rate", "tax type", "tax amount", "total amount", "qty"]),
    ("TOTAL", r"\btotal\s*:?"),
    ("AMOUNT_IN_WORDS", ["amount in words"]),
    ("SIGNATORY", ["authorized signatory"]),
    ("TAX_PAYMENT", ["reverse charge", "tax is payable"]),
    ("PAYMENT", ["payment transaction", "date & time", "invoice value", "mode of payment", "payment method"]),
]

# What routes an invoice to the structured branch, in batch and on upload.
BATCH_MARKERS = ["amazon.in", "amazon india", "amazon seller services", "amazon pay", "amazon marketplace", "amazon fulfillment", "amazon transport services"]
UPLOAD_VENDOR = "amazon"
UPLOAD_MARKERS = ["invoice", "tax invoice", "invoice no", "invoice number", "sold by", "order number", "order id"]

# Fixed values: (all of these substrings of a lower-cased log line, any alternative) -> stage, percent, label; first match.
PROGRESS = [
    ([["preparing document working directory"], ["working directory ready"]], 0, 5, "Preparing your document"),
    ([["step: ocr"], ["running:", "pdf_ocr.py"]], 1, 18, "Reading the document with OCR"),
    ([["ocr completed"]], 1, 28, "OCR completed · identifying document type"),
    ([["step: document classification"]], 2, 36, "Identifying the document structure"),
    ([["document classification completed"]], 2, 42, "Document type identified"),
    ([["detected type"]], 3, 45, "Routing the document to the right workflow"),
    ([["step: field extraction"]], 3, 58, "Extracting invoice information"),
    ([["field extraction completed"]], 3, 64, "Invoice information extracted"),
    ([["step: table extraction"]], 3, 68, "Reading line items and charges"),
    ([["table extraction completed"]], 3, 73, "Line items identified"),
    ([["step: invoice integration"]], 3, 77, "Combining extracted information"),
    ([["invoice integration completed"]], 3, 81, "Structured result assembled"),
    ([["step: invoice validation"]], 4, 86, "Checking extracted values"),
    ([["invoice validation completed"]], 4, 91, "Validation completed"),
    ([["step: invoice export"]], 5, 95, "Preparing downloadable outputs"),
    ([["invoice export completed"]], 5, 99, "Outputs ready"),
    ([["non-invoice document handling"], ["route         : generic"]], 5, 90, "Preparing readable OCR result"),
]
