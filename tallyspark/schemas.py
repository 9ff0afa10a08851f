"""One schema per stored table."""

from __future__ import annotations

from pyspark.sql import types as T

_SHORT = {
    "s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "b": T.BooleanType(),
    "d": T.DateType(), "t": T.TimestampNTZType(), "f": T.DoubleType(),
    "m12": T.DecimalType(12, 2), "m10": T.DecimalType(10, 2),
}


def _schema(text: str) -> T.StructType:
    """``"name:type ..."`` with the short type codes above."""
    pairs = (item.split(":") for item in text.split())
    return T.StructType([T.StructField(name, _SHORT[code]) for name, code in pairs])


RAW_DOCUMENTS = _schema(
    "file_name:s file_path:s doc_type:s staged_at:t extracted:b extracted_at:t "
    "extraction_error:s page_count:i file_size_bytes:l"
)
INVOICES = _schema(
    "invoice_id:l file_name:s vendor_name:s invoice_number:s po_number:s invoice_date:d due_date:d "
    "payment_terms:s bill_to:s subtotal:m12 tax_amount:m12 total_amount:m12 status:s payment_date:d extracted_at:t"
)
LINE_ITEMS = _schema(
    "line_item_id:l file_name:s invoice_number:s line_number:i product_name:s category:s "
    "quantity:m10 unit_price:m10 line_total:m12"
)
VENDORS = _schema("vendor_id:l vendor_name:s address:s default_terms:s")
FIELDS = _schema(
    "record_id:l file_name:s field_1:s field_2:s field_3:s field_4:d field_5:d field_6:s field_7:s "
    "field_8:m12 field_9:m12 field_10:m12 raw_extraction:s status:s extracted_at:t"
)
TABLE_DATA = _schema(
    "line_id:l file_name:s record_id:s line_number:i col_1:s col_2:s col_3:m10 col_4:m10 col_5:m12 raw_line_data:s"
)
DOCUMENT_REVIEW = _schema(
    "review_id:l record_id:l file_name:s review_status:s corrected_vendor_name:s corrected_invoice_number:s "
    "corrected_po_number:s corrected_invoice_date:d corrected_due_date:d corrected_payment_terms:s "
    "corrected_recipient:s corrected_subtotal:m12 corrected_tax_amount:m12 corrected_total:m12 "
    "reviewer_notes:s reviewed_by:s reviewed_at:t corrections:s"
)
LINE_REVIEW = _schema(
    "review_id:l line_id:l file_name:s record_id:s corrected_col_1:s corrected_col_2:s corrected_col_3:m10 "
    "corrected_col_4:m10 corrected_col_5:m12 corrections:s reviewer_notes:s reviewed_by:s reviewed_at:t"
)
DOC_TYPE_CONFIG = _schema(
    "doc_type:s display_name:s extraction_prompt:s field_labels:s table_extraction_schema:s review_fields:s "
    "validation_rules:s active:b"
)
ALERTS = _schema("alert_id:l alert_name:s fired_at:t failed_count:l total_files:l message:s")
CONTRACT_TRUTH = _schema(
    "file_name:s party_name:s contract_number:s reference_id:s effective_date:s expiration_date:s terms:s "
    "counterparty:s base_value:f adjustments:f total_value:f milestone_count:i"
)
RECEIPT_TRUTH = _schema(
    "file_name:s merchant_name:s receipt_number:s transaction_id:s purchase_date:s return_by_date:s "
    "payment_method:s subtotal:f tax_amount:f total_paid:f item_count:i"
)
BILL_TRUTH = _schema(
    "file_name:s utility_company:s account_number:s meter_number:s service_address:s billing_period_start:s "
    "billing_period_end:s rate_schedule:s kwh_usage:f demand_kw:f previous_balance:f current_charges:f "
    "total_due:f due_date:s tier_count:i"
)
