"""Profiles, rules, labels and word lists: fixed values of the inventory, kept small and bound into expressions."""

from __future__ import annotations

# --- Fixed values -----------------------------------------------------------
CURRENCIES = ["USD", "EUR", "GBP", "AED", "SAR", "EGP", "JOD", "KWD", "QAR", "BHD", "OMR"]

#: key, type, label, required, cross-check
INVOICE_FIELDS = [
    ("invoice_number", "string", "Invoice number", True, False),
    ("invoice_date", "date", "Invoice date", True, False),
    ("due_date", "date", "Due date", False, False),
    ("seller_name", "string", "Seller / supplier name", True, False),
    ("seller_tax_id", "string", "Seller tax ID", False, True),
    ("seller_address", "string", "Seller address", False, False),
    ("buyer_name", "string", "Buyer / customer name", True, False),
    ("buyer_tax_id", "string", "Buyer tax ID", False, True),
    ("buyer_address", "string", "Buyer address", False, False),
    ("currency", "enum", "Currency", False, False),
    ("subtotal", "currency", "Subtotal before tax", False, True),
    ("tax_amount", "currency", "Tax amount", False, True),
    ("tax_rate", "number", "Tax rate (%)", False, True),
    ("discount_amount", "currency", "Discount amount", False, True),
    ("shipping_amount", "currency", "Shipping / handling", False, True),
    ("total_amount", "currency", "Total amount", True, True),
    ("amount_due", "currency", "Amount due / balance", False, True),
    ("payment_method", "string", "Payment method", False, False),
    ("bank_name", "string", "Bank name", False, False),
    ("iban", "string", "IBAN", False, False),
    ("payment_terms", "string", "Payment terms", False, False),
    ("notes", "text", "Notes / terms conditions", False, False),
    ("line_items", "array", "Line items", False, False),
]
#: key, kind, required, pattern, min, max, checks the currency list
INVOICE_RULES = [
    ("invoice_number", "string", True, None, None, None, False),
    ("invoice_date", "date", True, None, None, None, False),
    ("seller_name", "string", True, None, None, None, False),
    ("buyer_name", "string", True, None, None, None, False),
    ("total_amount", "currency", True, None, None, None, False),
    ("currency", "enum", False, None, None, None, True),
    ("invoice_date", "string", False, r"^\d{4}-\d{2}-\d{2}$", None, None, False),
    ("tax_rate", "number", False, None, 0.0, 100.0, False),
]
RECEIPT_FIELDS = [
    ("receipt_number", "string", "Receipt number", True, False),
    ("receipt_date", "date", "Receipt date", True, False),
    ("merchant_name", "string", "Merchant / store name", True, False),
    ("merchant_tax_id", "string", "Merchant tax ID", False, True),
    ("merchant_address", "string", "Merchant address", False, False),
    ("customer_name", "string", "Customer name", False, False),
    ("transaction_id", "string", "Transaction ID (رقم العملية)", False, True),
    ("reference_number", "string", "Reference number (الرقم المرجعي)", False, True),
    ("customer_id", "string", "Customer ID (رقم العميل)", False, True),
    ("account_number", "string", "Account number (رقم الحساب)", False, True),
    ("mobile_number", "string", "Customer mobile number", False, True),
    ("currency", "enum", "Currency", False, False),
    ("subtotal", "currency", "Subtotal", False, True),
    ("tax_amount", "currency", "Tax amount", False, True),
    ("discount_amount", "currency", "Discount amount", False, True),
    ("total_amount", "currency", "Total amount", True, True),
    ("payment_method", "string", "Payment method", False, False),
    ("cashier_name", "string", "Cashier", False, False),
    ("pos_number", "string", "POS / terminal number", False, False),
    ("description", "string", "Service / description", False, False),
    ("notes", "text", "Notes / footer text", False, False),
    ("line_items", "array", "Line items", False, False),
]
RECEIPT_RULES = [
    ("receipt_number", "string", True, None, None, None, False),
    ("receipt_date", "date", True, None, None, None, False),
    ("merchant_name", "string", True, None, None, None, False),
    ("total_amount", "currency", True, None, None, None, False),
    ("currency", "enum", False, None, None, None, True),
    ("receipt_date", "string", False, r"^\d{4}-\d{2}-\d{2}$", None, None, False),
    ("transaction_id", "string", False, r"^\d{16}$", None, None, False),
    ("reference_number", "string", False, r"^20\d{8}$", None, None, False),
    ("mobile_number", "string", False, r"^01[0125]\d{8}$", None, None, False),
]
CONTRACT_FIELDS = [
    ("contract_title", "string", "Contract title", True, False),
    ("contract_date", "date", "Contract date", True, False),
    ("effective_date", "date", "Effective date", False, False),
    ("expiry_date", "date", "Expiry / termination date", False, True),
    ("party_a_name", "string", "Party A (first party)", True, False),
    ("party_a_type", "enum", "Party A type", False, False),
    ("party_b_name", "string", "Party B (second party)", True, False),
    ("party_b_type", "enum", "Party B type", False, False),
    ("jurisdiction", "string", "Jurisdiction / governing law", False, False),
    ("currency", "enum", "Currency", False, False),
    ("contract_value", "currency", "Contract value", False, True),
    ("payment_terms", "string", "Payment terms", False, False),
    ("renewal_terms", "string", "Renewal terms", False, False),
    ("notice_period", "string", "Notice period", False, False),
    ("governing_law", "string", "Governing law", False, False),
    ("signatories", "array", "Signatories", False, False),
    ("key_obligations", "array", "Key obligations", False, False),
    ("summary", "text", "Summary", False, False),
]
CONTRACT_RULES = [
    ("contract_title", "string", True, None, None, None, False),
    ("contract_date", "date", True, None, None, None, False),
    ("party_a_name", "string", True, None, None, None, False),
    ("party_b_name", "string", True, None, None, None, False),
    ("contract_date", "string", False, r"^\d{4}-\d{2}-\d{2}$", None, None, False),
]
RESUME_FIELDS = [
    ("full_name", "string", "Full name", True, False),
    ("job_title", "string", "Current job title", False, False),
    ("phone", "string", "Phone", False, False),
    ("email", "string", "Email", False, True),
    ("location", "string", "Location / address", False, False),
    ("linkedin", "string", "LinkedIn URL", False, False),
    ("portfolio_url", "string", "Portfolio / website", False, False),
    ("summary", "text", "Professional summary", False, False),
    ("years_of_experience", "number", "Years of experience", False, True),
    ("skills", "array", "Skills", False, False),
    ("languages", "array", "Languages", False, False),
    ("experience", "array", "Work experience", False, False),
    ("education", "array", "Education", False, False),
    ("certifications", "array", "Certifications", False, False),
    ("projects", "array", "Projects", False, False),
]
RESUME_RULES = [
    ("full_name", "string", True, None, None, None, False),
    ("email", "string", False, r"^[^\s@]+@[^\s@]+\.[^\s@]+$", None, None, False),
]
#: Profiles whose missing fields are no fault, and what their fields are called where a category's words announce them.
LENIENT = ["receipt"]
GROUP_OF_FIELD = {"transaction_id": "number", "reference_number": "number", "customer_id": "buyer", "account_number": "pos", "mobile_number": "phone"}
PROFILES = {
    "invoice": (INVOICE_FIELDS, INVOICE_RULES),
    "receipt": (RECEIPT_FIELDS, RECEIPT_RULES),
    "resume": (RESUME_FIELDS, RESUME_RULES),
    "contract": (CONTRACT_FIELDS, CONTRACT_RULES),
}

#: Words that name a profile, in order of the profiles.
ALIASES = {
    "invoice": ["invoice", "فاتورة", "facture", "faktur", "boleta", "nota fiscal"],
    "receipt": ["receipt", "إيصال", "reçu", "kwitansi", "bon", "ticket", "fiskal", "purchase", "payment", "transaction", "عملية ناجحة", "رقم الحساب", "رقم البطاقة", "رقم العميل"],
    "resume": ["resume", "cv", "curriculum vitae", "سيرة ذاتية", "lebenslauf", "履历"],
    "contract": ["contract", "agreement", "عقد", "ميثاق", "accordo", "contrat"],
}

#: Words by which a line names the category of its value, in order of the categories.
LABELS = {
    "number": ["المرجعي", "المرجقي", "مرجعي", "المعاملة", "التمليه", "رقم العملية", "انعمليه", "رقم المعاملة", "reference", "ref no", "ref", "transaction id", "receipt no", "invoice no", "serial"],
    "phone": ["mobile number", "mobile", "phone", "tel", "هاتف", "الجوال", "جوال", "الموبايل", "موبايل"],
    "date": ["التاريخ", "تاريخ", "التوقيت", "الوقت", "تاريخ الاصدار", "تاريخ الاستحقاق", "استحقاق", "issued", "date", "datetime", "time", "due", "period", "فترة"],
    "tax": ["الرقم الضريبي", "الضريبي", "الضريبية", "الضريبة", "السجل التجاري", "الرقم الموحد", "vrn", "vat", "tax no", "tax id", "tax", "tin", "crn", "gst"],
    "total": ["الإجمالي", "الاجمالي", "المجموع", "المطلوب", "العلى", "الاجمالي المستحق", "المستحق", "إجمالي الفاتورة", "اجمالي الفاتوره", "الصافي", "الصافى", "المبلغ النهائي", "المبلغ النهائى", "grand total", "total", "amount due", "balance", "المبلغ الاجمالي"],
    "subtotal": ["الإجمالي الفرعي", "الاجمالي الفرعي", "المجموع الفرعي", "المجموع الفرعى", "المبلغ قبل الضريبة", "المبلغ قبل الضريبه", "subtotal"],
    "price": ["السعر", "سعر الوحدة", "سعر الوحده", "سعر القطعة", "سعر القطعه", "unit price", "price"],
    "quantity": ["الكمية", "الكميه", "العدد", "quantity"],
    "item_name": ["الصنف", "اسم الصنف", "البيان", "الوصف", "البند"],
    "currency": ["العملة", "currency", "ريال", "درهم", "دينار", "جنيه", "دولار", "يورو", "د.ك", "ر.س"],
    "merchant": ["التاجر", "البائع", "المورد", "المحل", "الشركة", "merchant", "seller", "vendor", "store", "trading"],
    "buyer": ["المشتري", "العميل", "customer", "buyer", "client"],
    "payment": ["الدفع", "طريقة الدفع", "البطاقة", "نقدي", "شبكة", "payment", "method", "card", "cash", "tap"],
    "pos": ["الحساب", "حساب", "نقطة البيع", "الطرفية", "pos", "terminal", "tid"],
    "notes": ["ملاحظات", "ملاحظة", "معلومات", "إضافية", "اضافية", "notes", "note", "info", "footer"],
}

#: Category that a field key expects beside its value: exact keys, then beginnings and endings.
GROUP_OF_KEY = {
    "notes": "notes", "line_items": "items", "items": "items", "currency": "currency", "total_amount": "total", "amount_due": "total", "subtotal": "subtotal",
    "unit_price": "price", "price": "price", "item_price": "price", "quantity": "quantity", "qty": "quantity", "item_name": "item_name", "item": "item_name", "item_description": "item_name",
    "tax_amount": "tax", "tax_rate": "tax", "merchant_name": "merchant", "seller_name": "merchant", "vendor_name": "merchant", "customer_name": "buyer", "buyer_name": "buyer",
    "payment_method": "payment", "pos_number": "pos", "terminal_id": "pos", "merchant_tax_id": "tax", "seller_tax_id": "tax", "buyer_tax_id": "tax",
}
UNCERTAINTY = {
    "recovered_from_ocr": "value was recovered directly from the OCR text by label matching, not independently verified",
    "ambiguous_candidates": "several distinct candidates appear in the document and the correct one could not be determined",
    "ocr_confidence_low": "OCR confidence for this value is low (blurry, faint, or misread characters)",
    "label_not_matched": "value was found in the text but no matching field label sat on the same line",
    "no_direct_evidence": "value does not directly appear in the OCR text and was inferred rather than read verbatim",
    "ocr_near_duplicate": "the OCR text contains near-identical candidate values and the correct one could not be resolved",
    "inferred_by_position": "value was chosen by its position and size in the document, not by a matching label",
    "entity_cleaned": "value was repaired by a generic entity cleaner (e.g. OCR character or spacing noise)",
}
ERRORS = {"FILE_NOT_FOUND": 404, "PROFILE_NOT_FOUND": 404, "EMPTY_SOURCE": 422, "EXTRACTION_FAILED": 502, "PIPELINE_INTERRUPTED": 409, "UNSUPPORTED_FORMAT": 400, "RATE_LIMITED": 429}
# ----------------------------------------------------------------------------


def labels_by_length() -> list[tuple[str, str]]:
    """(word, category), longest first; equal lengths in order of the categories."""
    pairs = [(w.lower(), group) for group, words in LABELS.items() for w in words]
    return sorted(pairs, key=lambda p: -len(p[0]))
