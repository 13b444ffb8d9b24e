"""Rules that a new installation starts with."""

# Id, sender key, regex, direction, channel, status.
RULES = [
    ("r_hdfc_upi_debit_v1", "HDFCBK", r"Rs\.? ?(?P<amount>[\d,]+(?:\.\d{1,2})?) debited from A/c [X*]+(?P<acct>\d{4}) on [\d/-]+ to VPA (?P<vpa>[\w.\-]+@\w+)\.? UPI Ref:? (?P<ref>\d{6,})", "DEBIT", "UPI", "SUCCESS"),
    ("r_hdfc_atm_v1", "HDFCBK", r"Rs\.? ?(?P<amount>[\d,]+(?:\.\d{1,2})?) withdrawn at ATM \w+ from A/c [X*]+(?P<acct>\d{4}) on [\d/-]+\.? Avl bal Rs\.? ?(?P<bal>[\d,]+(?:\.\d{1,2})?)", "DEBIT", "ATM", "SUCCESS"),
    ("r_hdfc_upi_refund_v1", "HDFCBK", r"Refund of Rs\.? ?(?P<amount>[\d,]+(?:\.\d{1,2})?) for UPI txn (?P<ref>\d{6,}) has been credited to A/c [X*]+(?P<acct>\d{4})", "CREDIT", "UPI", "REVERSED"),
    ("r_sbi_neft_credit_v1", "SBIINB", r"A/c [X*]+(?P<acct>\d{4}) is credited with Rs\.? ?(?P<amount>[\d,]+(?:\.\d{1,2})?) on \w+ by (?:NEFT|IMPS|RTGS) from (?P<merchant>[^.]+?)\. Avl Bal Rs\.? ?(?P<bal>[\d,]+(?:\.\d{1,2})?)", "CREDIT", "NETBANKING", "SUCCESS"),
    ("r_sbi_upi_debit_v1", "SBIUPI", r"A/C [X*]+(?P<acct>\d{4}) debited by (?P<amount>[\d,]+(?:\.\d{1,2})?) on date \w+ trf to (?P<merchant>.+?) Refno (?P<ref>\d{6,})", "DEBIT", "UPI", "SUCCESS"),
    ("r_icici_card_spend_v1", "ICICIT", r"INR (?P<amount>[\d,]+(?:\.\d{1,2})?) spent on ICICI Bank Card [X*]+(?P<acct>\d{4}) on [\w-]+ at (?P<merchant>[^.]+?)\. Avl Limit", "DEBIT", "CARD", "SUCCESS"),
    ("r_icici_upi_debit_v1", "ICICIT", r"ICICI Bank Acct [X*]+(?P<acct>\d{3,4}) debited for Rs\.? ?(?P<amount>[\d,]+(?:\.\d{1,2})?) on [\w-]+; (?P<merchant>.+?) credited\. UPI:(?P<ref>\d{6,})", "DEBIT", "UPI", "SUCCESS"),
    ("r_kotak_upi_failed_v1", "KOTAKB", r"transaction of Rs\.? ?(?P<amount>[\d,]+(?:\.\d{1,2})?) to (?P<vpa>[\w.\-]+@\w+) has FAILED\. Amount if debited will be refunded within (?P<days>\d+) working days\. UPI Ref:? (?P<ref>\d{6,})", "DEBIT", "UPI", "FAILED"),
    ("r_axis_imps_credit_v1", "AXISBK", r"Amt Rs\.? ?(?P<amount>[\d,]+(?:\.\d{1,2})?) credited to A/c no\. [X*]+(?P<acct>\d{4}) via IMPS\. Ref:? (?P<ref>\d{6,})", "CREDIT", "NETBANKING", "SUCCESS"),
    ("r_yes_upi_pending_v1", "YESBNK", r"Rs\.? ?(?P<amount>[\d,]+(?:\.\d{1,2})?) is pending for UPI txn to (?P<vpa>[\w.\-]+@\w+)\. Status will update shortly\. Ref:? (?P<ref>\d{6,})", "DEBIT", "UPI", "PENDING"),
    ("r_idfc_emi_debit_v1", "IDFCFB", r"Rs\.? ?(?P<amount>[\d,]+(?:\.\d{1,2})?) debited from your a/c [X*]+(?P<acct>\d{4}) for EMI towards (?P<merchant>[^.]+?)\. Ref:? (?P<ref>\d{6,})", "DEBIT", "NETBANKING", "SUCCESS"),
    ("r_phonepe_paid_v1", "com.phonepe.app", r"^Paid (?:₹|Rs\.? ?)(?P<amount>[\d,]+(?:\.\d{1,2})?) to (?P<merchant>.+?)\. UPI Ref No\.? (?P<ref>\d{6,})", "DEBIT", "UPI", "SUCCESS"),
    ("r_gpay_received_v1", "com.google.android.apps.nbu.paisa.user", r"^You received (?:₹|Rs\.? ?)(?P<amount>[\d,]+(?:\.\d{1,2})?) from (?P<vpa>[\w.\-]+@\w+)$", "CREDIT", "UPI", "SUCCESS"),
    ("r_paytm_paid_v1", "net.one97.paytm", r"^Paid (?:₹|Rs\.? ?)(?P<amount>[\d,]+(?:\.\d{1,2})?) to (?P<merchant>.+?) via Paytm UPI\. Ref:? (?P<ref>\d{6,})", "DEBIT", "UPI", "SUCCESS"),
]


def seed_rules() -> list[dict]:
    return [dict(zip(("id", "sender", "regex", "direction", "channel", "status"), r, strict=True)) for r in RULES]
