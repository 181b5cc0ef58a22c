"""Strings, labels and component values as Column expressions. A null label counts as empty."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words in labels, in the order in which they are tried.
CLOCK = ("CLK", "CLOCK", "MCLK", "BCLK", "PCLK", "REFCLK", "SYSCLK", "XTAL", "OSC")
RESET_LOW = ("/RESET", "RESET_N", "RESET#", "NRST", "NRESET", "RST_N", "POR_N")
RESET_HIGH = ("RESET", "RST", "POR", "PWRGOOD_RESET")
POWER = ("VCC", "VDD", "VBAT", "+5V", "+3V3", "+12V", "POWER")
GROUND = ("GND", "VSS", "GROUND", "0V")
HIGH_SPEED = ("USB", "PCIE", "ETH", "HDMI", "MIPI", "DDR", "CLK")
SILK_LABELS = ("GND", "VCC", "VIN", "VOUT", "3V3", "5V", "12V")
PIN_ROLES = (
    ("ground", 0.95, ("GND", "VSS", "GROUND")),
    ("power", 0.9, ("VCC", "VDD", "+5V", "+3V3", "VBUS", "VBAT")),
    ("signal_out_or_bidir", 0.65, ("TX", "MOSI", "SDA", "D+", "CANH")),
    ("signal_in_or_bidir", 0.65, ("RX", "MISO", "SCL", "D-", "CANL")),
)
SERIAL = (("I2C", ("SCL", "SDA")), ("SPI", ("MISO", "MOSI", "SCLK")), ("UART", ("RX", "TX")), ("CAN", ("CANH", "CANL")))
DEBUG = (("SWD", ("SWCLK", "SWDIO")), ("JTAG", ("TCK", "TDI", "TDO", "TMS")))
DEBUG_RESET = ("NRST", "RESET_N", "NTRST", "TRST")
SILK_REFERENCES = (("reference_resistor", "R"), ("reference_capacitor", "C"), ("reference_ic", "(?:U|IC)"), ("reference_diode", "D"), ("reference_connector", "J"))
KIND_PREFIX = {"resistor": "R", "capacitor": "C", "inductor": "L", "led": "D", "diode": "D", "connector": "J", "ic": "U", "integrated_circuit": "U", "transistor": "Q", "testpoint": "TP", "fuse": "F"}
PIN_FUNCTIONS = {
    "GND": "ground", "VSS": "ground", "0V": "ground", "SDA": "i2c_sda", "SCL": "i2c_scl", "MOSI": "spi_mosi", "MISO": "spi_miso", "SCLK": "spi_clock",
    "TX": "uart_tx", "RX": "uart_rx", "CANH": "can_h", "CANL": "can_l", "D+": "usb_dp", "D-": "usb_dm",
}


def upper(label: Column) -> Column:
    return F.upper(F.coalesce(label, F.lit("")))


def squeezed(label: Column) -> Column:
    return F.replace(upper(label), F.lit(" "), F.lit(""))


def any_in(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def normal_text(value: Column) -> Column:
    """Trimmed, in upper case, single spaces."""
    return F.trim(F.regexp_replace(upper(value), r"\s+", " "))


def normal_reference(value: Column) -> Column:
    return F.replace(normal_text(value), F.lit(" "), F.lit(""))


def strict_reference(value: Column) -> Column:
    """Letters, digits, at most one letter; else empty."""
    s = squeezed(F.trim(value))
    return F.when(s.rlike(r"^[A-Z]+[0-9]+[A-Z]?$"), s).otherwise("")


def reference_parts(value: Column) -> Column:
    """(prefix, number, suffix), null for what is no reference."""
    s = strict_reference(value)
    part = lambda k: F.regexp_extract(s, r"^([A-Z]+)([0-9]+)([A-Z]?)$", k)
    return F.when(s != "", F.struct(part(1).alias("prefix"), part(2).cast("bigint").alias("number"), part(3).alias("suffix")))


def split_references(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"[,;\s]+"), lambda p: p != "")


def net_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\s+", "_")


def header(name: str) -> str:
    return "_".join(name.strip().lower().split())


def safe_label(text: Column, limit: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), 1, limit)


def truncate(text: Column, limit: int = 80) -> Column:
    """Of a longer text the first limit - 1 characters and an ellipsis."""
    if limit < 1:
        raise ValueError("limit must be positive")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def safe_class_name(name: Column) -> Column:
    """All but letters, digits, _ and - as _; Generated for an empty name."""
    s = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}_-]", "_")
    return F.when(s == "", "Generated").otherwise(s)


@F.pandas_udf(StringType())
def _shortest(v: pd.Series) -> pd.Series:
    return v.map(lambda x: f"{x:g}", na_action="ignore")


def general(v: Column) -> Column:
    """A number in the shortest of fixed and scientific notation with six significant digits, without zeros at the end.

    Halves go by the exact binary value, as in C: Java's formats round the shortest decimal instead.
    """
    return _shortest(v.cast("double"))


def _engineering(v: Column, scales: tuple[tuple[float, str], ...]) -> Column:
    size, unit = F.lit(scales[-1][0]), F.lit(scales[-1][1])
    for scale, name in reversed(scales[:-1]):
        size, unit = F.when(v >= scale, scale).otherwise(size), F.when(v >= scale, name).otherwise(unit)
    return F.concat(general(v / size), unit)


def format_resistance(ohms: Column) -> Column:
    """4700 is 4.7kΩ."""
    return _engineering(ohms.cast("double"), ((1e6, "MΩ"), (1e3, "kΩ"), (1.0, "Ω")))


def format_capacitance(farads: Column) -> Column:
    """1e-7 is 100nF."""
    return _engineering(farads.cast("double"), ((1e-6, "µF"), (1e-9, "nF"), (1e-12, "pF")))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 12 digits of the SHA-1 of the parts joined by |; the parts are strings."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 12))


def clock_score(label: Column) -> Column:
    return F.when(any_in(upper(label), CLOCK), 0.7).otherwise(0.0)


def clock_hits(label: Column) -> Column:
    s = upper(label)
    return F.filter(F.array(*[F.when(F.contains(s, F.lit(w)), F.lit("label:" + w)) for w in CLOCK]), lambda x: x.isNotNull())


def reset_label(label: Column) -> Column:
    """(active_low, confidence); null active_low where the label names no reset."""
    s = squeezed(label)
    low, high = any_in(s, RESET_LOW), any_in(s, RESET_HIGH)
    return F.struct(F.when(low, True).when(high, False).alias("active_low"), F.when(low, 0.8).when(high, 0.7).otherwise(0.0).alias("confidence"))


def net_class(label: Column, is_diff: Column, max_width: Column) -> Column:
    """(class_name, confidence, evidence)."""
    s = upper(label)
    row = lambda n, c, e: F.struct(F.lit(n).alias("class_name"), F.lit(c).alias("confidence"), F.lit(e).alias("evidence"))
    return (
        F.when(any_in(s, GROUND), row("ground", 0.95, "label_ground"))
        .when(any_in(s, POWER), row("power", 0.9, "label_power"))
        .when(F.coalesce(is_diff, F.lit(False)), row("differential", 0.9, "pair_evidence"))
        .when(any_in(s, HIGH_SPEED), row("high_speed", 0.75, "label_high_speed"))
        .when(F.coalesce(max_width >= 0.8, F.lit(False)), row("power_candidate", 0.55, "wide_trace"))
        .otherwise(row("signal", 0.4, "default_physical"))
    )


def pin_role(label: Column) -> Column:
    s, out = upper(label), None
    for name, confidence, words in PIN_ROLES:
        row = F.struct(F.lit(name).alias("role"), F.lit(confidence).alias("confidence"))
        out = F.when(any_in(s, words), row) if out is None else out.when(any_in(s, words), row)
    return out.otherwise(F.struct(F.lit("signal").alias("role"), F.lit(0.4).alias("confidence")))


def pin_function(label: Column) -> Column:
    s = squeezed(label)
    out = F.when(s == next(iter(PIN_FUNCTIONS)), PIN_FUNCTIONS[next(iter(PIN_FUNCTIONS))])
    for name, role in list(PIN_FUNCTIONS.items())[1:]:
        out = out.when(s == name, role)
    for role, words in (("power", ("VCC", "VDD", "+3V3", "+5V", "+12V", "VBUS")), ("gpio", ("GPIO",)), ("analog_input", ("ADC", "AIN")), ("pwm", ("PWM",))):
        out = out.when(any_in(s, words), role)
    return out


def serial_role(label: Column) -> Column:
    """(protocol, role), words of one protocol in alphabetical order."""
    s, out = squeezed(label), None
    for protocol, words in (*SERIAL, ("SPI", ("CS",)), ("SPI", ("NSS",))):
        for w in words:
            row = F.struct(F.lit(protocol).alias("protocol"), F.lit("CS" if w == "NSS" else w).alias("role"))
            out = F.when(F.contains(s, F.lit(w)), row) if out is None else out.when(F.contains(s, F.lit(w)), row)
    return out


def debug_role(label: Column) -> Column:
    s, out = F.replace(squeezed(label), F.lit("/"), F.lit("")), None
    for protocol, words in DEBUG:
        for w in words:
            row = F.struct(F.lit(protocol).alias("protocol"), F.lit(w).alias("signal"))
            out = F.when(F.contains(s, F.lit(w)), row) if out is None else out.when(F.contains(s, F.lit(w)), row)
    return out.when(any_in(s, DEBUG_RESET), F.struct(F.lit("RESET").alias("protocol"), F.lit("RESET").alias("signal")))


# Patterns of memory signals after an optional DDR_, the first that fits counts.
DDR_ROLES = (("data", r"DQ\d+"), ("strobe", r"DQS[PN]?\d*"), ("address", r"A\d+"), ("bank", r"BA\d+"), ("command", r"(?:RAS|CAS|WE|CS|CKE|ODT)_?N?"), ("clock", r"CK[PN]?\d*"))


def ddr_role(label: Column) -> Column:
    s, out = squeezed(label), None
    for role, pattern in DDR_ROLES:
        test = s.rlike(rf"^(?:DDR_)?{pattern}$")
        out = F.when(test, role) if out is None else out.when(test, role)
    return out


def silk_token(token: Column) -> Column:
    s, out = F.trim(upper(token)), None
    for name, prefix in SILK_REFERENCES:
        test = s.rlike(rf"^{prefix}\d+$")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(s.isin(*SILK_LABELS), "net_label_candidate").otherwise("unknown")


def prefix_for_kind(kind: Column) -> Column:
    s, out = F.lower(F.coalesce(kind, F.lit(""))), None
    for name, prefix in KIND_PREFIX.items():
        out = F.when(s == name, prefix) if out is None else out.when(s == name, prefix)
    return out.otherwise("U")


def indexed_label(label: Column) -> Column:
    """(base, index) of DATA3, DATA_3 or DATA[3]; null for labels without a number at the end."""
    s = F.trim(upper(label))
    base = F.regexp_replace(F.regexp_extract(s, r"^(.*?)[_\[]?(\d+)\]?$", 1), "_+$", "")
    raw = F.regexp_extract(s, r"^(.*?)[_\[]?(\d+)\]?$", 1)
    return F.when(raw != "", F.struct(base.alias("base"), F.regexp_extract(s, r"^(.*?)[_\[]?(\d+)\]?$", 2).cast("decimal(38,0)").cast("bigint").alias("index")))


def voltage(label: Column) -> Column:
    """3V3 is 3.3, +5V is 5.0, -12V is -12.0; null without a voltage."""
    s = squeezed(label)
    split, plain = r"([+-]?\d+)V(\d+)", r"([+-]?\d+(?:\.\d+)?)V"
    whole, frac = F.regexp_extract(s, split, 1), F.regexp_extract(s, split, 2)
    both = F.concat(F.regexp_replace(whole, "[+-]", ""), F.lit("."), frac).try_cast("double")
    return F.when(frac != "", F.when(whole.startswith("-"), -both).otherwise(both)).otherwise(F.regexp_extract(s, plain, 1).try_cast("double"))


def frequency(value: Column) -> Column:
    """Hertz of 8MHz, 32.768kHz, 100."""
    s = squeezed(F.trim(value))
    out = None
    for suffix, scale in (("GHZ", 1e9), ("MHZ", 1e6), ("KHZ", 1e3), ("HZ", 1.0)):
        number = F.substring(s, F.lit(1), F.length(s) - len(suffix)).try_cast("double") * scale
        out = F.when(s.endswith(suffix), number) if out is None else out.when(s.endswith(suffix), number)
    return F.when(value.isNull(), None).otherwise(out.otherwise(s.try_cast("double")))


def _scaled(s: Column, scales: dict[str, str]) -> Column:
    letters = "".join(k for k in scales if k)
    number, unit = F.regexp_extract(s, rf"^(\d+(?:\.\d+)?)([{letters}]?)$", 1), F.regexp_extract(s, rf"^(\d+(?:\.\d+)?)([{letters}]?)$", 2)
    out = F.lit(1.0)
    for k, v in scales.items():
        if k:
            out = F.when(unit == k, float(v)).otherwise(out)
    return F.when(number != "", number.try_cast("double") * out)


def _bare(value: Column, *drop: str) -> Column:
    s = F.trim(F.upper(value))
    for d in drop:
        s = F.replace(s, F.lit(d), F.lit(""))
    return s


def resistance(value: Column) -> Column:
    """Ohms of 10k, 4.7M, 220; 4R7 is not read here."""
    return _scaled(_bare(value, "Ω", "OHM", " "), {"": "1", "K": "1e3", "M": "1e6", "G": "1e9"})


def resistance_r(value: Column) -> Column:
    """Ohms of 4R7, 10k, 33R: R is the decimal point."""
    s = _bare(value, "Ω", "OHM")
    scale = F.when(s.endswith("K"), 1e3).when(s.endswith("M"), 1e6).otherwise(1.0)
    number = F.replace(F.when(scale > 1, F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s), F.lit("R"), F.lit("."))
    return number.try_cast("double") * scale


def capacitance(value: Column) -> Column:
    return _scaled(F.replace(_bare(value, "F", " "), F.lit("µ"), F.lit("U")), {"": "1", "P": "1e-12", "N": "1e-9", "U": "1e-6"})


def inductance(value: Column) -> Column:
    return _scaled(F.replace(_bare(value, "H", " "), F.lit("µ"), F.lit("U")), {"": "1", "N": "1e-9", "U": "1e-6", "M": "1e-3"})


def resistor_marking(text: Column) -> Column:
    """Ohms of 103, 4702, 4R7, 0."""
    s = F.trim(F.upper(text))
    code = lambda k: F.substring(s, 1, k).try_cast("double") * F.pow(F.lit(10.0), F.substring(s, k + 1, 1).try_cast("double"))
    return F.when(s.isin("0", "000", "0R0"), 0.0).when(F.contains(s, F.lit("R")), F.replace(s, F.lit("R"), F.lit(".")).try_cast("double")).when(s.rlike(r"^\d{3}$"), code(2)).when(s.rlike(r"^\d{4}$"), code(3))


def capacitor_marking(text: Column) -> Column:
    """Farads of a three-digit code in picofarads."""
    s = F.trim(F.upper(text))
    return F.when(s.rlike(r"^\d{3}$"), F.substring(s, 1, 2).try_cast("double") * F.pow(F.lit(10.0), F.substring(s, 3, 1).try_cast("double")) * 1e-12)


def complementary(a: Column, b: Column) -> Column:
    """Whether two net names differ only by the suffixes of a differential pair."""
    out = F.lit(False)
    for p, n in (("_P", "_N"), ("+", "-"), ("_DP", "_DM")):
        stem = lambda s, k: F.substring(s, F.lit(1), F.length(s) - k)
        out = out | (a.endswith(p) & (b == F.concat(stem(a, len(p)), F.lit(n)))) | (b.endswith(p) & (a == F.concat(stem(b, len(p)), F.lit(n))))
    return out
