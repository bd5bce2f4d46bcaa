"""Word lists, patterns and tables of the ledger domain (fixed values)."""

# Patterns that reject a message before parsing, in order of evaluation.
STRONG_REJECT = (
    r"(?i)\b(otp|one[-\s]?time\s+password|verification\s+code|auth(?:entication)?\s+code)\b",
    r"(?i)\byour\s+(login|signin|sign-in)\s+code\b",
    r"(?i)\bdo\s+not\s+share\s+(this\s+)?(otp|code)\b",
)
MARKETING_REJECT = (
    r"(?i)\b(unsubscribe|click\s+here|limited\s+period\s+offer|flat\s+\d+%\s+off)\b",
    r"(?i)\b(congrat(?:ulation)?s!?)\b.*\b(won|winner|lottery|prize)\b",
)
DELIVERY_REJECT = (r"(?i)\b(out\s+for\s+delivery|package\s+delivered|tracking\s+id)\b",)
FINANCIAL_POSITIVE = (
    r"(?i)\b(debited|credited|spent|withdrawn|purchase|payment|refunded|reversed|transferred)\b",
    r"(?i)\b(upi|neft|imps|rtgs|a/?c\s+\*|xx+\d{2,})\b",
    r"(?i)(?:rs\.?|inr|₹)\s*[0-9]",
)
AMOUNT_HINT = r"(?i)(?:rs\.?|inr|₹)\s*[0-9]|[0-9]+\.[0-9]{2}"

# Payment rails, first match wins.
PAYMENT_METHODS = (
    ("UPI", r"(?i)\b(upi|vpa|@oksbi|@okhdfc|@ybl|@paytm)\b"),
    ("ATM", r"(?i)\b(atm|cash\s+w/?d|cash\s+withdrawal)\b"),
    ("CARD", r"(?i)\b(card|pos|visa|mastercard|rupay|\*{4}\d{4}|xx\d{4})\b"),
    ("NET_BANKING", r"(?i)\b(neft|imps|rtgs|netbanking|net\s+banking)\b"),
    ("WALLET", r"(?i)\b(wallet|paytm\s+wallet|amazon\s+pay\s+balance)\b"),
    ("BILL_PAYMENT", r"(?i)\b(bill\s+pay(?:ment)?|bbps)\b"),
)

# Merchant cleaning.
PROCESSOR_PREFIX = r"(?i)^(paytm|ph|mm|az|gpay|googlepay|bharatpe|razorpay|freecharge|mobikwik)\s*[\*\-/:]+\s*"
WWW_PREFIX = r"(?i)^www\."
OWN_ACCOUNT = r"(?i)\b(own\s*a/?c|own\s+account|self\s+transfer|to\s+self|my\s+account)\b"
# token -> (key, display); tokens are folded keys, which hold no dots
MERCHANT_ALIASES = {
    "swiggy": ("swiggy", "Swiggy"),
    "zomato": ("zomato", "Zomato"),
    "amazon": ("amazon", "Amazon"),
    "amzn": ("amazon", "Amazon"),
    "flipkart": ("flipkart", "Flipkart"),
    "fkrt": ("flipkart", "Flipkart"),
    "uber": ("uber", "Uber"),
    "ola": ("ola", "Ola"),
    "olacabs": ("ola", "Ola"),
    "netflix": ("netflix", "Netflix"),
    "spotify": ("spotify", "Spotify"),
    "bigbasket": ("bigbasket", "BigBasket"),
    "bbnow": ("bigbasket", "BigBasket"),
    "blinkit": ("blinkit", "Blinkit"),
    "grofers": ("blinkit", "Blinkit"),
}

# The 16 system categories in their order.
CATEGORIES = (
    ("food_and_dining", "Food and dining"),
    ("groceries", "Groceries"),
    ("shopping", "Shopping"),
    ("transport", "Transport"),
    ("fuel", "Fuel"),
    ("bills_and_utilities", "Bills and utilities"),
    ("entertainment", "Entertainment"),
    ("travel", "Travel"),
    ("health", "Health"),
    ("education", "Education"),
    ("rent_and_housing", "Rent and housing"),
    ("subscriptions", "Subscriptions"),
    ("cash_withdrawal", "Cash withdrawal"),
    ("transfers", "Transfers"),
    ("income_and_refunds", "Income and refunds"),
    ("other", "Other"),
)
EXACT_CATEGORIES = {
    "swiggy": "food_and_dining",
    "zomato": "food_and_dining",
    "uber": "transport",
    "ola": "transport",
    "amazon": "shopping",
    "flipkart": "shopping",
    "netflix": "subscriptions",
    "spotify": "subscriptions",
    "bigbasket": "groceries",
    "blinkit": "groceries",
}
KEYWORD_CATEGORIES = (
    (r"(?i)\b(swiggy|zomato|restaurant|cafe|dining|food)\b", "food_and_dining"),
    (r"(?i)\b(grocery|groceries|supermarket|dmart|bigbasket|blinkit|instamart)\b", "groceries"),
    (r"(?i)\b(amazon|flipkart|myntra|ajio|shopping)\b", "shopping"),
    (r"(?i)\b(uber|ola|rapido|metro|cab|taxi)\b", "transport"),
    (r"(?i)\b(petrol|diesel|fuel|iocl|hpcl|bpcl|shell)\b", "fuel"),
    (r"(?i)\b(electricity|broadband|airtel|jio|bsnl|vodafone|bbps|utility)\b", "bills_and_utilities"),
    (r"(?i)\b(bookmyshow|pvr|hotstar|disney|entertainment)\b", "entertainment"),
    (r"(?i)\b(makemytrip|goibibo|indigo|airindia|hotel|flight)\b", "travel"),
    (r"(?i)\b(pharmacy|apollo|1mg|practo|hospital|clinic)\b", "health"),
    (r"(?i)\b(byju|unacademy|coursera|udemy|tuition)\b", "education"),
    (r"(?i)\b(rent|housing|landlord)\b", "rent_and_housing"),
    (r"(?i)\b(netflix|spotify|subscription|mandate)\b", "subscriptions"),
)

# Text that looks like an unredacted message or a financial secret.
SECRET_PATTERNS = (
    r"(?i)rs\.?\s*[\d,]+\.?\d*",
    r"(?i)\binr\s*[\d,]+\.?\d*",
    r"\d{12,}",
    r"(?i)\botp\s*(is|:)?\s*\d{4,8}",
    r"(?i)\ba/?c\s*(xx)?\d{2,}",
    r"(?i)upi\s*ref",
    r"(?i)\S+@(oksbi|okhdfc|okicici|ybl|axl|ibl)\b",
)
# JSON keys that no payload may hold, folded to letters and digits.
PROHIBITED_KEYS = (
    "sms", "smsbody", "body", "amount", "currency", "merchant", "institution", "account", "card", "upi",
    "reference", "transaction", "transactions", "category", "subscription", "sender", "totals",
)
# Closed sets of the telemetry and support payloads.
TELEMETRY_EVENT_TYPES = (
    "scan_started", "scan_completed", "scan_failed", "parser_update_checked", "parser_update_activated",
    "parser_update_failed", "app_error",
)
DURATION_BUCKETS = ("LT_1S", "1S_5S", "5S_15S", "15S_30S", "30S_60S", "1M_5M", "GT_5M")
COUNT_BUCKETS = ("0", "1_10", "11_50", "51_200", "201_1000", "1001_PLUS")
SUPPORT_REASONS = ("no_rule_match", "parse_failed", "incorrect_extraction", "other")

# Closed sets of the ledger's columns.
DIRECTIONS = ("DEBIT", "CREDIT", "REFUND", "REVERSAL", "TRANSFER")
STATUSES = ("NONE", "SUSPECTED", "CONFIRMED")
SUBSCRIPTION_STATUSES = ("SUSPECTED", "CONFIRMED", "DISMISSED", "POSSIBLY_INACTIVE")
SCAN_STATUSES = ("PENDING", "RUNNING", "COMPLETED", "INTERRUPTED", "CANCELLED", "FAILED")
