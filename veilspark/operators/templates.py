"""Prompt templates of both generators, and the formats of the values that fill them. Wording is ours; an entity's type stands in braces."""

from __future__ import annotations

#: First generator: five categories of five templates.
FIRST = {
    "financial_reports": [
        "Compare the results of {YEAR} with those of {YEAR} and note where revenue passed {AMOUNT}.",
        "List the main figures of the report at {URL} for {PERSON}.",
        "Which chapters of {URL} explain the loss of {AMOUNT} in {YEAR}?",
        "Draft five lines on the outlook for {YEAR}; file them as {DOCUMENT_REF}.",
        "Check the total of {AMOUNT} in {DOCUMENT_REF} against {URL}.",
    ],
    "customer_agreements": [
        "Prepare the contract {DOCUMENT_REF} of customer {CUSTOMER_ID} for signature by {PERSON}.",
        "Tell {PERSON} by {EMAIL} that the limit of {CUSTOMER_ID} is now {AMOUNT}.",
        "Customer {CUSTOMER_ID} wants account {IBAN} closed; call {PHONE_NUMBER} first.",
        "Translate agreement {DOCUMENT_REF} between {PERSON} and {PERSON}.",
        "Is {IBAN} the account that {CUSTOMER_ID} named in {YEAR}?",
    ],
    "infrastructure": [
        "Restart {APP_ID} and send the log to {EMAIL}.",
        "{CORP_KEY} asks for access to {APP_ID} until the end of {YEAR}.",
        "Why does {APP_ID} refuse the sign-in of {CORP_KEY}?",
        "Move {APP_ID} behind {URL} and tell {PERSON}.",
        "Write a runbook for {APP_ID}; owner is {CORP_KEY}.",
    ],
    "payments_transfers": [
        "Trace transfer {TRANSFER_ID} of {AMOUNT} from {IBAN} to {IBAN}.",
        "Has {TRANSFER_ID} reached {CUSTOMER_ID}? If not, call {PHONE_NUMBER}.",
        "Stop all transfers over {AMOUNT} from {IBAN} today.",
        "{PERSON} disputes {TRANSFER_ID}; refund {AMOUNT}.",
        "Confirm {TRANSFER_ID} to {EMAIL} with reference {DOCUMENT_REF}.",
    ],
    "employee_operations": [
        "Enrol {PERSON} with key {CORP_KEY} in the course of {YEAR}.",
        "Send the payslip of {CORP_KEY} to {EMAIL}.",
        "{PERSON} moves to the team of {PERSON}; new phone {PHONE_NUMBER}.",
        "Approve the expenses of {AMOUNT} that {CORP_KEY} filed as {DOCUMENT_REF}.",
        "Plan the review of {PERSON} for {YEAR}.",
    ],
}

#: Second generator: seventeen areas of four templates.
SECOND = {
    "account_opening": [
        "Open an account for {PERSON}, born {DATE_OF_BIRTH}, passport {PASSPORT}.",
        "Customer {CUSTOMER_ID} of {ADDRESS}, {POSTAL_CODE}, wants a second account beside {IBAN}.",
        "Verify identity card {NATIONAL_ID} and licence {DRIVING_LICENSE} of {PERSON}.",
        "Welcome {PERSON} at {EMAIL}; the number is {ACCOUNT_NUMBER}.",
    ],
    "loan_processing": [
        "Loan {LOAN_ID} of {AMOUNT} at {INTEREST_RATE}: income is {INCOME}, score {CREDIT_SCORE}.",
        "Mortgage {MORTGAGE_ID} has {LOAN_BALANCE} left; {PERSON} earns {SALARY}.",
        "Ask {EMPLOYER} whether {PERSON} works there as {OCCUPATION}.",
        "Raise the limit of {CUSTOMER_ID} to {CREDIT_LIMIT} on {DATE}.",
    ],
    "payments_transfers": [
        "Pay {AMOUNT} from {IBAN} to {IBAN} for {PERSON}, reference {PAYMENT_REF}.",
        "Check wire {WIRE_REF} of {AMOUNT} sent by {CUSTOMER_ID} to {BIC_SWIFT}.",
        "Mandate {MANDATE_ID} failed twice: {SEPA_REF} and {SEPA_REF}.",
        "Route {TRANSACTION_ID} by {ROUTING_NUMBER} instead of {SORT_CODE}.",
    ],
    "corporate_accounts": [
        "Company {COMPANY_REG} with VAT number {VAT_NUMBER} adds {PERSON} as signatory.",
        "Pool the cash of {IBAN} and {IBAN} under {CUSTOMER_ID}.",
        "Match {DUNS_NUMBER} with {LEI_CODE}.",
        "The overdraft of {COMPANY_REG} stands at {AMOUNT}.",
    ],
    "trade_finance": [
        "Letter of credit {DOCUMENT_REF} over {AMOUNT} expires {EXPIRY_DATE}.",
        "Release the goods of {COMPANY_REG} once {WIRE_REF} is in.",
        "Bank {BIC_SWIFT} confirms {AMOUNT} for {LEI_CODE}.",
        "Who signed {DOCUMENT_REF} on {DATE}?",
    ],
    "securities_trading": [
        "Buy {TICKER} for {INVESTMENT_AMOUNT} in portfolio {PORTFOLIO_ID}.",
        "Order on {ISIN} by {CUSTOMER_ID} was rejected on {DATE}.",
        "Settle {TRANSACTION_ID} against {ACCOUNT_NUMBER}.",
        "Compare {TICKER} and {TICKER}.",
    ],
    "wealth_management": [
        "Move {INVESTMENT_AMOUNT} of {PERSON} out of {PORTFOLIO_ID}.",
        "{PERSON} has a salary of {SALARY} and wants {ISIN}.",
        "Review portfolio {PORTFOLIO_ID} with {CUSTOMER_ID} on {DATE}.",
        "Write to {PERSON} at {EMAIL} or {PHONE_NUMBER} about file {DOCUMENT_REF}.",
    ],
    "fraud_detection": [
        "Card {CREDIT_CARD} was used from {IP_ADDRESS} and {IP_ADDRESS} within an hour.",
        "Block {DEBIT_CARD} of {PERSON}; case {AML_CASE}.",
        "Report {SAR_ID} names {IBAN} and {AMOUNT}.",
        "Device {MAC_ADDRESS} opened session {SESSION_ID}.",
    ],
    "regulatory_reporting": [
        "File {FATCA_ID} for tax id {TAX_ID}.",
        "{CRS_ID} lists {PERSON} with {SSN}.",
        "Add {SAR_ID} and {AML_CASE} to the report of {DATE}.",
        "The report at {URL} needs {LEI_CODE}.",
    ],
    "credit_risk": [
        "Score {CREDIT_SCORE} of {CUSTOMER_ID} with limit {CREDIT_LIMIT} and balance {LOAN_BALANCE}.",
        "Set aside {AMOUNT} for loan {LOAN_ID}.",
        "Stress {MORTGAGE_ID} at {INTEREST_RATE}.",
        "Which loans of {EMPLOYER} fall due before {EXPIRY_DATE}?",
    ],
    "mobile_banking": [
        "The app of {CUSTOMER_ID} shows {TOKEN} instead of the balance.",
        "Reset the phone {PHONE_NUMBER} for {EMAIL}.",
        "Session {SESSION_ID} from {IP_ADDRESS} timed out.",
        "{PERSON} can't add card {DEBIT_CARD}.",
    ],
    "api_banking": [
        "Key {API_KEY} calls {URL} too often.",
        "Revoke {TOKEN}; owner is {EMAIL}.",
        "Endpoint {URL} returns {TRANSACTION_ID} twice.",
        "Rotate {API_KEY} on {DATE}; nothing else than {UNLISTED} is open.",
    ],
    "life_insurance": [
        "Policy {POLICY_NUMBER} of {PERSON}, born {DATE_OF_BIRTH}, costs {PREMIUM}.",
        "Pay claim {CLAIM_ID} of {AMOUNT} to {IBAN}.",
        "Change the beneficiary of {POLICY_NUMBER} to {PERSON}.",
        "Send {POLICY_NUMBER} to {ADDRESS}.",
    ],
    "property_insurance": [
        "Claim {CLAIM_ID} at {ADDRESS}: damage of {AMOUNT}.",
        "Renew {POLICY_NUMBER} before {EXPIRY_DATE} for {PREMIUM}.",
        "Inspect {ADDRESS}, {POSTAL_CODE}, with {PERSON}.",
        "Photos of {CLAIM_ID} are in {FILE_PATH}.",
    ],
    "customer_service": [
        "Call {PERSON} back at {PHONE_NUMBER}.",
        "Renew the file of {CUSTOMER_ID}: {PERSON}, born {DATE_OF_BIRTH}, living at {ADDRESS}.",
        "{PERSON} complains about {AMOUNT} on {ACCOUNT_NUMBER}.",
        "Answer {EMAIL} about card {CREDIT_CARD}, valid to {EXPIRY_DATE}.",
    ],
    "system_operations": [
        "Copy {FILE_PATH} to {IP_ADDRESS}.",
        "Close session {SESSION_ID} from {IP_ADDRESS}.",
        "Host {MAC_ADDRESS} lost {FILE_PATH}.",
        "Summarise the report of {DATE} at {URL} and {URL}.",
    ],
    "audit_scenarios": [
        "Who changed {DOCUMENT_REF} on {DATE}?",
        "Sample {TRANSACTION_ID}, {TRANSACTION_ID} and {TRANSACTION_ID}.",
        "{PERSON} approved {AMOUNT} for {VAT_NUMBER}.",
        "Archive the minutes of the meeting.",
    ],
}

#: In a format each of these stands for a digit of the value's number, and for a letter that the digit picks.
DIGITS, LETTERS, ALPHABET = "αβγδεζηθικλμ", "бгджзилпфцшэ", "AKRTBNMZLE"
_MONEY = ["€1αβ,γδε.ζη", "$9α,βγδ.εζ", "£4αβ.γδ", "2,αβγ,δεζ.ηθ CHF", "7αβ.γδ SEK", "8,αβγ.δε DKK", "0.αβ NOK"]
_TAX = ["1αβ-2γ-3δεζ", "4αβγδεζηθ", "NL5αβγδεζηθB1ι", "BE1αβγδεζηθι", "DE2αβγδεζηθ", "FRбг3αβγδεζηθ"]
_CARD = ["4111 αβγδ εζηθ ικλμ", "5555 αβγδ εζηθ ικλμ", "3714 αβγδεζ ηθικλ", "6011 αβγδ εζηθ ικλμ"]
#: Formats of the types' values; a type without one has its name and six digits.
FORMATS = {
    "IBAN": ["BE1α βγδε ζηθι κλμ0", "NL2α ABNA βγδε ζηθι κλ", "DE3α βγδε ζηθι κλμ0"],
    "ACCOUNT_NUMBER": ["1αβγδεζηθ", "2αβγδεζηθι", "3αβγδεζη-1θι", "ACC4αβγδε", "5αβγ-6δεζηθ"],
    "CREDIT_CARD": _CARD,
    "DEBIT_CARD": _CARD,
    "BIC_SWIFT": ["бгджBE22", "бгджNL2A001", "бгджDE33XXX"],
    "ROUTING_NUMBER": ["1αβγδεζηθ"],
    "SORT_CODE": ["1α-2β-3γ"],
    "TAX_ID": _TAX,
    "VAT_NUMBER": _TAX,
    "SSN": ["1αβ-2γ-3δεζ"],
    **dict.fromkeys(["AMOUNT", "LOAN_BALANCE", "INVESTMENT_AMOUNT", "PREMIUM", "CREDIT_LIMIT"], _MONEY),
    "SALARY": ["€2α,βγδ annually"],
    "INCOME": ["€1,αβγ/month"],
    "TRANSACTION_ID": ["TXN1αβγδεζηθικλ"],
    "PAYMENT_REF": ["PAY-1αβγδε-2ζηθ"],
    "WIRE_REF": ["WIRE1αβγδεζη"],
    "SEPA_REF": ["SEPA1αβγδεζηθ"],
    "MANDATE_ID": ["MNDT1αβγδε"],
    "LOAN_ID": ["LOAN1αβγδεζηθ"],
    "MORTGAGE_ID": ["MTG1αβγδεζη"],
    "INTEREST_RATE": ["α.βγ%"],
    "CREDIT_SCORE": ["3αβ", "4αβ", "5αβ", "6αβ", "7αβ"],
    "PERSON": ["Ada Brook", "Tom Hazel", "Mira Lind", "Jonas Ferry", "Lea Stone", "Paul Winter", "Nora Field"],
    "CUSTOMER_ID": ["CUST-αβγδεζ", "CLI1αβγδε", "REL_2αβγ", "1αβγδεζη"],
    "PASSPORT": ["P1αβγδεζη"],
    "DRIVING_LICENSE": ["DL1αβγδεζη"],
    "NATIONAL_ID": ["ID1αβγδεζηθ"],
    "EMAIL": ["userαβγδ@example.com", "u.αβγ@example.org"],
    "PHONE_NUMBER": ["+32 4αβγδεζηθ", "555-01αβ"],
    "ADDRESS": ["1α Mill Lane, Oldtown", "2β Quay Street, Newport"],
    "POSTAL_CODE": ["1αβγ", "2αβγ AB"],
    "EMPLOYER": ["Harbour Works", "North Mill", "Green Depot"],
    "OCCUPATION": ["baker", "surveyor", "teacher"],
    "POLICY_NUMBER": ["POL1αβγδεζηθ"],
    "CLAIM_ID": ["CLM1αβγδεζ"],
    "PORTFOLIO_ID": ["PF1αβγδε"],
    "ISIN": ["USб", "NLб", "DEб", "FRб"],
    "TICKER": ["бгд", "бгдж", "бгджз"],
    "COMPANY_REG": ["REG1αβγδεζη"],
    "DUNS_NUMBER": ["1αβγδεζηθ"],
    "LEI_CODE": ["бгαβджγδзиεζлпηθфцικ"],
    "IP_ADDRESS": ["10.1αβ.2γ.δ"],
    "MAC_ADDRESS": ["0α:1β:2γ:3δ:4ε:5ζ"],
    "SESSION_ID": ["αβγδεζηθ-1ικλ-4μαβ-8γδε-ζηθικλμαβγδε"],
    "API_KEY": ["αβγδεζηθικλμαβγδεζηθικλμαβγδεζηθ"],
    "TOKEN": ["μλκιθηζεδγβαμλκιθηζεδγβαμλκιθηζε"],
    "FATCA_ID": ["FATCA1αβγδε"],
    "CRS_ID": ["CRS1αβγδεζ"],
    "AML_CASE": ["AML1αβγδε"],
    "SAR_ID": ["SAR1αβγδεζ"],
    "DOCUMENT_REF": ["DOCбαгβдγжδ"],
    "URL": ["https://www.example.com/αβγδε", "https://files.example.com/m/αβγδεζηθ/original/report.pdf"],
    "FILE_PATH": ["/secure/data/αβγδ.txt"],
    "YEAR": ["201α", "202β"],
    "CORP_KEY": ["CK1αβγδε"],
    "APP_ID": ["App_α", "App_1β"],
    "TRANSFER_ID": ["TXN1αβγδεζηθ", "TRF2αβγδεζηθ", "PAY3αβγδεζηθ", "WIRE4αβγδεζηθ"],
}
#: Dates and months are counted, not spelled.
DATES, MONTHS = ["DATE", "DATE_OF_BIRTH"], ["EXPIRY_DATE"]


def rows(templates: dict[str, list[str]]) -> list[tuple[int, str, str]]:
    """Number, category and text of each template."""
    return [(i, c, t) for i, (c, t) in enumerate((c, t) for c, texts in templates.items() for t in texts)]
