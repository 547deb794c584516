"""Fixed values of the controller's instruction set."""

#: The operand positions (from 0) that each instruction writes; an instruction's other operands are read.
WRITES: dict[str, tuple[int, ...]] = {
    "OTE": (0,), "OTL": (0,), "OTU": (0,), "ONS": (0,), "OSR": (0, 1), "OSF": (0, 1), "TON": (0,), "TOF": (0,), "RTO": (0,), "TONR": (0,), "TOFR": (0,), "RTOR": (0,),
    "CTU": (0,), "CTD": (0,), "CTUD": (0,), "RES": (0,), "MOV": (1,), "MVM": (2,), "COP": (1,), "CPS": (1,), "FLL": (1,), "CLR": (0,), "BTD": (3,), "BTDT": (0,),
    "ADD": (2,), "SUB": (2,), "MUL": (2,), "DIV": (2,), "MOD": (2,), "XPY": (2,), "SQR": (1,), "SQRT": (1,), "NEG": (1,), "ABS": (1,), "SIN": (1,), "COS": (1,), "TAN": (1,),
    "ASN": (1,), "ACS": (1,), "ATN": (1,), "LN": (1,), "LOG": (1,), "DEG": (1,), "RAD": (1,), "TOD": (1,), "FRD": (1,), "TRN": (1,), "TRUNC": (1,),
    "AND": (2,), "OR": (2,), "XOR": (2,), "NOT": (1,), "BAND": (0,), "BOR": (0,), "BXOR": (0,), "BNOT": (0,), "SWPB": (2,), "CPT": (0,), "SCL": (0,), "SCP": (5,),
    "BSL": (0, 1), "BSR": (0, 1), "FFL": (1, 2), "FFU": (1, 2), "LFL": (1, 2), "LFU": (1, 2), "SQO": (2, 3), "SQI": (3,), "SQL": (0, 2), "FAL": (0,), "FSC": (0,),
    "FBC": (3, 4), "DDT": (3, 4), "AVE": (1, 2), "SRT": (1,), "STD": (2, 3), "SIZE": (2,), "GSV": (3,), "MSG": (0,), "PID": (0, 4), "PIDE": (0,), "ALMD": (0,), "ALMA": (0,),
    "CONCAT": (2,), "MID": (3,), "DTOS": (1,), "STOD": (1,), "RTOS": (1,), "STOR": (1,), "UPPER": (1,), "LOWER": (1,), "DELETE": (3,), "INSERT": (3,), "FIND": (4,),
    "MAOC": (0,), "MSO": (1,), "MSF": (1,), "MAS": (1,), "MAM": (1,), "MAJ": (1,), "MAH": (1,), "MRP": (1,),
    "EVENT": (), "JSR": (), "SBR": (), "RET": (), "JMP": (), "LBL": (), "TND": (), "MCR": (), "NOP": (), "AFI": (), "UID": (), "UIE": (), "SFR": (), "SFP": (), "EOT": (),
}

#: Known mnemonics beyond those above (contacts, compares, program control, motion, safety, process).
ALSO_KNOWN = (
    "XIC XIO EQU NEQ LES LEQ GRT GEQ LIM MEQ CMP DDD JXR IOT SSV"
    " MASD MASR MDO MDF MAFR MAW MAR MAG MCD MAPC MATC MDAC MGS MGSD MGSR MGSP MCS MCLM MCCM MCT MCTP MCSD MCSR MDCC MRAT MAHD"
    " ESTOP ROUT DCS DCST DCSTL DCSTM DCSRT DCM SMAT TSAM TSSM THRS THRSE LC CROUT DIN ENPEN FPMS CBCM CBIM CBSSM AVC MMVC SFX SLS SOS SS1 SS2 STO SDI SBC SLP SSM SLT SSX SCK SCA"
    " RMPS POSP SRTP LDLG FGEN TOT DEDT LDL2 HPF LPF NTCH INTG SCRV PI DERV SNEG SEL ESEL SSUM MUX HLL RLIM MAXC MINC MAVE MSTD LLL DFF JKFF RESD SETD CUTD OSRI OSFI"
).split()

#: Operand 0 names a routine or label; operands are expressions; functions inside expressions; conditions of a rung.
NAME_FIRST = ("JSR", "SFR", "SFP", "JMP", "LBL")
EXPRESSIONS = ("CMP", "CPT", "FAL", "FSC")
EXPRESSION_FUNCTIONS = ("AND", "OR", "XOR", "NOT", "MOD", "ABS", "SQR", "SQRT", "SIN", "COS", "TAN", "ASN", "ACS", "ATN", "LN", "LOG", "DEG", "RAD", "TRN", "FRD", "TOD")
CONDITIONS = ("XIC", "XIO", "EQU", "NEQ", "LES", "LEQ", "GRT", "GEQ", "LIM", "MEQ", "CMP", "ONS")

#: Words of Structured Text that are no tags.
ST_KEYWORDS = (
    "IF THEN ELSIF ELSE END_IF CASE OF END_CASE FOR TO BY DO END_FOR WHILE END_WHILE REPEAT UNTIL END_REPEAT EXIT RETURN AND OR XOR NOT MOD TRUE FALSE"
).split()

#: Types that every controller has.
BUILTIN_TYPES = (
    "BOOL SINT INT DINT LINT USINT UINT UDINT ULINT REAL LREAL TIMER COUNTER CONTROL PID MESSAGE MOTION_INSTRUCTION STRING ALARM ALARM_ANALOG ALARM_DIGITAL"
    " AXIS_CONSUMED AXIS_VIRTUAL AXIS_SERVO AXIS_SERVO_DRIVE AXIS_CIP_DRIVE COORDINATE_SYSTEM MOTION_GROUP SERIAL_PORT_CONTROL CAM CAM_PROFILE OUTPUT_CAM OUTPUT_COMPENSATION"
    " PHASE PHASE_INSTRUCTION SFC_ACTION SFC_STEP SFC_STOP DATALOG_INSTRUCTION FBD_TIMER FBD_COUNTER FBD_ONESHOT FBD_BOOLEAN_AND FBD_BOOLEAN_OR FBD_BOOLEAN_XOR FBD_BOOLEAN_NOT"
    " FBD_COMPARE FBD_CONVERT FBD_LIMIT FBD_LOGICAL FBD_MASK_EQUAL FBD_MATH FBD_MATH_ADVANCED FBD_TRUNCATE FBD_BIT_FIELD_DISTRIBUTE ENERGY_BASE ENERGY_ELECTRICAL HMIBC CONNECTION_STATUS"
).split()
#: Types that hold one value.
ATOMIC_TYPES = "BOOL BIT SINT INT DINT LINT USINT UINT UDINT ULINT REAL LREAL".split()

#: Names of device profiles by product type.
PRODUCT_TYPES = {
    0: "Generic Device", 2: "AC Drive", 3: "Motor Overload", 4: "Limit Switch", 5: "Inductive Proximity Switch", 6: "Photoelectric Sensor", 7: "General Purpose Discrete I/O",
    9: "Resolver", 10: "General Purpose Analog I/O", 12: "Communications Adapter", 14: "Programmable Logic Controller", 16: "Position Controller", 19: "DC Drive", 21: "Contactor",
    22: "Motor Starter", 23: "Soft Start", 24: "Human-Machine Interface", 26: "Mass Flow Controller", 27: "Pneumatic Valve", 28: "Vacuum Pressure Gauge", 29: "Process Control Value",
    30: "Residual Gas Analyzer", 31: "DC Power Generator", 32: "RF Power Generator", 33: "Turbomolecular Vacuum Pump", 34: "Encoder", 35: "Safety Discrete I/O Device",
    36: "Fluid Flow Controller", 37: "CIP Motion Drive", 38: "CompoNet Repeater", 39: "Mass Flow Controller, Enhanced", 40: "CIP Modbus Device", 41: "CIP Modbus Translator",
    42: "Safety Analog I/O Device", 43: "Generic Device (keyable)", 44: "Managed Switch", 50: "ControlNet Physical Layer Component", 150: "Safety Drive",
}
#: Catalog numbers by vendor, product type and product code.
CATALOG = {
    (1, 14, 147): "1756-L72S", (1, 14, 146): "1756-L7SP", (1, 14, 213): "1756-L83ES", (1, 14, 171): "1756-L8SP", (1, 12, 166): "1756-EN2T", (1, 7, 11): "1756-IB16",
    (1, 0, 18): "ETHERNET-MODULE", (1, 0, 26): "ETHERNET-SAFETYMODULE", (43, 43, 20618): "BNI006A", (524, 43, 1): "501xxxxx",
    (645, 12, 2267): "BWU2380 BWU2381 BWU2267 BWU2317 BWU2579 BWU2742 BWU2821 BWU3079",
}
