"""Fixed values of the lending model contract.

FIXED VALUES: the lists, maps, edges and labels below must equal the
reference application's for equal results (feature order is part of a
fitted model's contract). They are stated here once, in natural order.
"""

# --- FIXED VALUES (feature lists, in model order) ---------------------------
CLF_FEATURES = [
    "Age", "AnnualIncome_INR", "DebtToIncomeRatio", "CreditUtilization",
    "CreditHistoryYears", "NumCreditAccounts", "NumHardInquiries",
    "MissedPayments", "Bankruptcies", "SavingsPct_Monthly",
    "SavingsBalance_INR", "ExistingDebt_INR", "UPI_TxnMonthly",
    "FinLiteracyScore", "EmergencyFundMonths", "FamilyBurdenScore",
    "HasProperty", "HasVehicle", "HasCreditCard", "HasFinancialPlan",
    "IncomeShockLast3Yr", "AppBasedLoan", "RepaymentHistory_Ord",
    "RiskScore", "EMI_to_Income", "SavingsToDebt", "YearsEmployed",
    "NumDependents",
]
REG_FEATURES = list(CLF_FEATURES)
CLU_FEATURES = [
    "AnnualIncome_INR", "CreditScore", "DebtToIncomeRatio",
    "CreditUtilization", "MissedPayments", "SavingsBalance_INR",
    "RiskScore", "FinLiteracyScore", "EmergencyFundMonths", "UPI_TxnMonthly",
]

# --- FIXED VALUES (batch upload contract) -----------------------------------
REQUIRED_BATCH_COLUMNS = [
    "Age", "AnnualIncome_INR", "DebtToIncomeRatio", "CreditUtilization",
    "CreditHistoryYears", "NumCreditAccounts", "MissedPayments", "Bankruptcies",
    "SavingsPct_Monthly", "SavingsBalance_INR", "ExistingDebt_INR",
    "FinLiteracyScore", "UPI_TxnMonthly", "EmergencyFundMonths",
]
BATCH_ZERO_DEFAULTS = [
    "HasProperty", "HasVehicle", "HasCreditCard", "HasFinancialPlan",
    "IncomeShockLast3Yr", "AppBasedLoan", "NumDependents", "YearsEmployed",
]

# --- FIXED VALUES (ordinal of repayment history; unknown -> 2) --------------
REPAYMENT_ORDINAL = {"Excellent": 4, "Good": 3, "Fair": 2, "Poor": 1}
REPAYMENT_UNKNOWN = 2

# --- FIXED VALUES (band edges and labels; intervals are (lo, hi]) -----------
SCORE_BAND_EDGES = [300, 500, 580, 670, 740, 800, 900]
SCORE_BAND_LABELS = ["Poor", "Below Avg", "Fair", "Good", "Very Good", "Exceptional"]
AGE_GROUP_EDGES = [18, 25, 35, 45, 55, 65]
AGE_GROUP_LABELS = ["18-25", "26-35", "36-45", "46-55", "56-65"]
QUARTILE_LABELS = ["Q1", "Q2", "Q3", "Q4"]

# --- FIXED VALUES (segments, decisions, actions) ----------------------------
MARKETING_PRIME_MIN = 740
MARKETING_EMERGING_MIN = 620
CLUSTER_NAMES = ["Prime", "Emerging", "Rebuilder", "At-Risk"]
DEFAULT_SEGMENT = "Emerging"
SEGMENT_ACTIONS = {
    "Prime": "Fast-track approval — premium product offer",
    "Emerging": "Nurture campaign — starter loan + follow-up",
    "Rebuilder": "Credit builder — secured loan only",
    "At-Risk": "Fin literacy only — no loan yet",
}
DEFAULT_ACTION = "Nurture campaign"
APPROVE_MIN = 0.60
BORDERLINE_MIN = 0.40
VOTE_WEIGHTS = {"gb": 0.5, "rf": 0.3, "lr": 0.2}

# --- FIXED VALUES (column lists of the analysis pages) ----------------------
FEATURE_GROUPS = {
    "Demographics": ["Age", "Gender", "MaritalStatus", "CityTier", "Education", "NumDependents"],
    "Employment & Income": ["EmploymentStatus", "YearsEmployed", "AnnualIncome_INR",
                            "IncomeStability", "SecondaryIncome_INR"],
    "Financial Behaviour": ["SavingsPct_Monthly", "SavingsBalance_INR", "SpendingPattern",
                            "CreditUtilization", "UPI_TxnMonthly", "HasCreditCard", "AppBasedLoan"],
    "Loans & Debt": ["PrimaryLoanType", "LoanAmountSought", "LoanTermMonths",
                     "ExistingDebt_INR", "MonthlyEMI_INR", "DebtToIncomeRatio"],
    "Credit History": ["CreditHistoryYears", "NumCreditAccounts", "NumHardInquiries",
                       "MissedPayments", "Bankruptcies", "RepaymentHistory"],
    "Assets": ["HasProperty", "HasVehicle", "InvestmentValue_INR", "EmergencyFundMonths"],
    "Behavioural": ["RiskTolerance", "FinLiteracyScore", "HasFinancialPlan",
                    "IncomeShockLast3Yr", "FamilyBurdenScore"],
    "Target Variables": ["CreditScore", "LoanApproved", "MarketingSegment"],
}
CORR_COLUMNS = [
    "Age", "AnnualIncome_INR", "SavingsBalance_INR", "ExistingDebt_INR",
    "DebtToIncomeRatio", "CreditUtilization", "CreditHistoryYears", "NumCreditAccounts",
    "NumHardInquiries", "MissedPayments", "Bankruptcies", "FinLiteracyScore",
    "UPI_TxnMonthly", "EmergencyFundMonths", "RiskScore", "CreditScore", "LoanApproved",
    "SavingsPct_Monthly", "YearsEmployed", "NumDependents", "FamilyBurdenScore",
]
GRID_COLUMNS = [
    "CreditScore", "AnnualIncome_INR", "DebtToIncomeRatio", "CreditUtilization",
    "MissedPayments", "RiskScore", "FinLiteracyScore", "EmergencyFundMonths",
    "SavingsPct_Monthly", "UPI_TxnMonthly", "CreditHistoryYears", "Age",
]
PROFILE_METRICS = [
    "CreditScore", "AnnualIncome_INR", "DebtToIncomeRatio", "CreditUtilization",
    "MissedPayments", "SavingsBalance_INR", "FinLiteracyScore", "EmergencyFundMonths",
]
PAIRPLOT_DEFAULTS = ["CreditScore", "AnnualIncome_INR", "DebtToIncomeRatio",
                     "RiskScore", "CreditUtilization"]
LABEL_ENCODED = [
    "Gender", "MaritalStatus", "CityTier", "Education", "EmploymentStatus",
    "IncomeStability", "SpendingPattern", "PrimaryLoanType", "LoanPurpose_New",
    "RepaymentHistory", "RiskTolerance", "MarketingSegment", "Persona",
    "CreditScoreBand", "AgeGroup", "IncomeQuartile",
]
# pandas' default CSV null tokens that occur in this data ("None", "NA", "nan")
PANDAS_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                    "n/a", "nan", "null"]

# --- FIXED VALUES (column lists of the EDA page) -----------------------------
EDA_NUMERIC = [
    "CreditScore", "AnnualIncome_INR", "DebtToIncomeRatio", "CreditUtilization", "Age",
    "SavingsPct_Monthly", "MissedPayments", "UPI_TxnMonthly", "FinLiteracyScore",
    "EmergencyFundMonths", "RiskScore", "SavingsBalance_INR", "CreditHistoryYears",
    "NumDependents", "ExistingDebt_INR",
]
EDA_CATEGORICAL = [
    "MarketingSegment", "EmploymentStatus", "CityTier", "Education", "RepaymentHistory",
    "SpendingPattern", "PrimaryLoanType", "IncomeStability", "RiskTolerance",
    "MaritalStatus", "Persona", "AgeGroup", "CreditScoreBand",
]
BOX_NUMERIC = ["CreditScore", "AnnualIncome_INR", "DebtToIncomeRatio", "CreditUtilization",
               "MissedPayments", "RiskScore", "FinLiteracyScore", "EmergencyFundMonths"]
BOX_GROUPS = ["LoanApproved", "MarketingSegment", "CityTier", "EmploymentStatus",
              "RepaymentHistory", "Education", "RiskTolerance"]
ENGINEERED = ["RiskScore", "EMI_to_Income", "SavingsToDebt", "FamilyBurdenScore",
              "CreditScoreBand", "AgeGroup", "IncomeLog", "ApprovalProbability"]

# Output columns of the fixture table (FIXTURES.md §5) and of the analysis base.
PROFILE_COLUMNS = [
    "cust_key", "RespondentID", "Persona", "CityTier", "Age", "NumDependents",
    "AnnualIncome_INR", "SavingsBalance_INR", "SavingsPct_Monthly", "ExistingDebt_INR",
    "CreditUtilization", "CreditHistoryYears", "NumCreditAccounts", "NumHardInquiries",
    "MissedPayments", "Bankruptcies", "RepaymentHistory", "FinLiteracyScore",
    "UPI_TxnMonthly", "EmergencyFundMonths", "HasProperty", "HasVehicle", "HasCreditCard",
    "HasFinancialPlan", "IncomeShockLast3Yr", "AppBasedLoan", "YearsEmployed",
    "MonthlyEMI_INR", "DebtToIncomeRatio", "RepaymentHistory_Ord", "CreditScore",
    "LoanApproved", "MarketingSegment",
]
CUSTOMER_COLUMNS = PROFILE_COLUMNS + ENGINEERED
CUSTOMER_STRING_COLUMNS = ["RespondentID", "Persona", "CityTier", "RepaymentHistory",
                           "MarketingSegment", "CreditScoreBand", "AgeGroup"]
CUSTOMER_NUMERIC_COLUMNS = [c for c in CUSTOMER_COLUMNS if c not in CUSTOMER_STRING_COLUMNS]
CUSTOMER_INT_COLUMNS = [
    "Age", "NumDependents", "CreditHistoryYears", "NumCreditAccounts", "NumHardInquiries",
    "MissedPayments", "Bankruptcies", "UPI_TxnMonthly", "HasProperty", "HasVehicle",
    "HasCreditCard", "HasFinancialPlan", "IncomeShockLast3Yr", "AppBasedLoan", "YearsEmployed",
    "RepaymentHistory_Ord", "LoanApproved",
]
