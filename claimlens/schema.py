"""The claim table: columns, types and domains.  Every operator takes these as parameters."""

from __future__ import annotations

from pyspark.sql import types as T

# The claim vocabulary (source spellings kept), natural order where there is one.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
DOMAINS: dict[str, list[str]] = {
    "Month": MONTHS,
    "DayOfWeek": WEEKDAYS,
    "Make": ["Accura", "BMW", "Chevrolet", "Dodge", "Ferrari", "Ford", "Honda", "Jaguar", "Lexus", "Mazda", "Mecedes", "Mercury", "Nisson", "Pontiac", "Porche", "Saab", "Saturn", "Toyota", "VW"],
    "AccidentArea": ["Rural", "Urban"],
    "DayOfWeekClaimed": WEEKDAYS,
    "MonthClaimed": MONTHS,
    "Sex": ["Female", "Male"],
    "MaritalStatus": ["Divorced", "Married", "Single", "Widow"],
    "Fault": ["Policy Holder", "Third Party"],
    "PolicyType": ["Sedan - All Perils", "Sedan - Collision", "Sedan - Liability", "Sport - All Perils", "Sport - Collision", "Sport - Liability", "Utility - All Perils", "Utility - Collision", "Utility - Liability"],
    "VehicleCategory": ["Sedan", "Sport", "Utility"],
    "VehiclePrice": ["less than 20000", "20000 to 29000", "30000 to 39000", "40000 to 59000", "60000 to 69000", "more than 69000"],
    "Days_Policy_Accident": ["none", "1 to 7", "8 to 15", "15 to 30", "more than 30"],
    "Days_Policy_Claim": ["none", "8 to 15", "15 to 30", "more than 30"],
    "PastNumberOfClaims": ["none", "1", "2 to 4", "more than 4"],
    "AgeOfVehicle": ["new", "2 years", "3 years", "4 years", "5 years", "6 years", "7 years", "more than 7"],
    "AgeOfPolicyHolder": ["16 to 17", "18 to 20", "21 to 25", "26 to 30", "31 to 35", "36 to 40", "41 to 50", "51 to 65", "over 65"],
    "PoliceReportFiled": ["No", "Yes"],
    "WitnessPresent": ["No", "Yes"],
    "AgentType": ["External", "Internal"],
    "NumberOfSuppliments": ["none", "1 to 2", "3 to 5", "more than 5"],
    "AddressChange_Claim": ["under 6 months", "1 year", "2 to 3 years", "4 to 8 years", "no change"],
    "NumberOfCars": ["1 vehicle", "2 vehicles", "3 to 4", "5 to 8", "more than 8"],
    "BasePolicy": ["All Perils", "Collision", "Liability"],
}
INTEGERS: dict[str, list[int] | None] = {
    "WeekOfMonth": [1, 2, 3, 4, 5],
    "WeekOfMonthClaimed": [1, 2, 3, 4, 5],
    "Age": None,
    "FraudFound_P": [0, 1],
    "PolicyNumber": None,
    "RepNumber": list(range(1, 17)),
    "Deductible": [300, 400, 500, 700],
    "DriverRating": [1, 2, 3, 4],
    "Year": [1994, 1995, 1996],
}
COLUMNS = [
    "Month", "WeekOfMonth", "DayOfWeek", "Make", "AccidentArea", "DayOfWeekClaimed", "MonthClaimed", "WeekOfMonthClaimed", "Sex", "MaritalStatus",
    "Age", "Fault", "PolicyType", "VehicleCategory", "VehiclePrice", "FraudFound_P", "PolicyNumber", "RepNumber", "Deductible", "DriverRating",
    "Days_Policy_Accident", "Days_Policy_Claim", "PastNumberOfClaims", "AgeOfVehicle", "AgeOfPolicyHolder", "PoliceReportFiled", "WitnessPresent",
    "AgentType", "NumberOfSuppliments", "AddressChange_Claim", "NumberOfCars", "Year", "BasePolicy",
]
TARGET, ID, ORIGIN = "FraudFound_P", "PolicyNumber", "is_synthetic"
NEVER_FEATURES = (ID, ORIGIN)
DISPLAY_ONLY = ("AgeOfPolicyHolder", "PolicyType")
CLAIMS = T.StructType([T.StructField(c, T.LongType() if c in INTEGERS else T.StringType()) for c in COLUMNS])

# Other spellings of the decisions.
DECISION_ALIASES = {
    "REQUEST_MORE_INFO": "REQUEST_MORE_INFORMATION",
    "REQUEST_INFO": "REQUEST_MORE_INFORMATION",
    "MORE_INFO": "REQUEST_MORE_INFORMATION",
    "FLAG": "FLAG_FOR_INVESTIGATION",
    "INVESTIGATE": "FLAG_FOR_INVESTIGATION",
}
DECISIONS = ("APPROVE", "FLAG_FOR_INVESTIGATION", "REQUEST_MORE_INFORMATION")
