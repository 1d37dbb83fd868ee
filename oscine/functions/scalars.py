"""Column functions of the signal domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microvolts of one converter step; limits of a signed 16-bit code; full scale in microvolts.
ADC_STEP_UV = 0.195
CODE_MIN, CODE_MAX = -32768, 32767
FULL_SCALE_UV = 6400.0
CLIP_SHARE = 0.95


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def uv_to_adc(uv: Column | str) -> Column:
    """Converter code of a voltage: half to even, limited to 16 bits."""
    return F.greatest(F.lit(CODE_MIN), F.least(F.lit(CODE_MAX), F.bround(col(uv) / ADC_STEP_UV).cast("int")))


def adc_to_uv(code: Column | str) -> Column:
    return col(code) * F.lit(ADC_STEP_UV)


def offset_binary_to_uv(code: Column | str) -> Column:
    return (col(code) - 32768) * F.lit(ADC_STEP_UV)


def lerp(lo: float, hi: float, severity: Column | str) -> Column:
    """Between lo and hi by a severity that is limited to [0, 1]."""
    return F.lit(float(lo)) + (hi - lo) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(severity)))


def lerp_int(lo: int, hi: int, severity: Column | str) -> Column:
    return F.bround(lerp(lo, hi, severity)).cast("int")


def clipped(uv: Column | str) -> Column:
    """1 if the voltage is beyond the clipping share of the full scale, else 0."""
    return (F.abs(col(uv)) > CLIP_SHARE * FULL_SCALE_UV).cast("double")


def isolation_db(power: Column, reference: Column, floor: float = -120.0) -> Column:
    """10 log10(power / reference), floor where that is not finite."""
    ratio = F.try_divide(power, reference)
    return F.when(ratio > 0, 10 * F.log10(ratio)).otherwise(F.lit(floor))


def ratio_or_inf(x: Column, y: Column) -> Column:
    return F.when(y > 0, x / y).otherwise(F.lit(float("inf")))


def safe_cv(mean: Column, std: Column) -> Column:
    """Coefficient of variation, 0 where the mean is about 0."""
    return F.when(F.abs(mean) > 1e-12, std / F.abs(mean)).otherwise(F.lit(0.0))


def ticks_to_seconds(ticks: Column | str, rate: float | Column) -> Column:
    return col(ticks) / rate


def window_centre(start: Column | str, end: Column | str, fs: float) -> Column:
    """Middle of a window of samples, in seconds."""
    return (col(start) + col(end)) / 2 / fs


def realtime_factor(signal_s: Column | str, took_s: Column | str) -> Column:
    """Seconds of signal that are worked on in a second; null where no time was taken."""
    return F.try_divide(col(signal_s).cast("double"), col(took_s).cast("double"))


def csv_number(x: Column | str, digits: int = 6) -> Column:
    """A number as text, blank where it is missing or no number; zero is written."""
    x = col(x).cast("double")
    return F.when(x.isNull() | F.isnan(x), "").otherwise(F.format_string(f"%.{digits}f", x))


def cut_or_padded(values: Column | str, size: int, fill: float = 0.0) -> Column:
    """An array cut, or filled up at its end, to a size."""
    values = col(values)
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(size) - F.size(values)))), 1, size)


def finite(x: Column | str) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def wilson(k: Column, n: Column, z: float = 1.96, empty: tuple[float, float] = (0.0, 0.0)) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k in n; empty where n is 0."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / m
    middle = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z / (1 + z * z / m) * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    low, high = F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)
    return F.when(m.isNull(), empty[0]).otherwise(low), F.when(m.isNull(), empty[1]).otherwise(high)


def snap(v: Column | str, grid: float = 5e-5) -> Column:
    """A coordinate as a whole number of grid steps."""
    return F.bround(col(v) / grid).cast("long")


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of logits, shifted by their maximum."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def trial_file(session: Column, trial: Column, kind: Column, level: Column) -> Column:
    return F.format_string("S%d_T%02d_%s_%s.rhd", session, trial, kind, level)


def status_bits(raw: Column) -> dict[str, Column]:
    """The flags of a status byte. The bit of each flag, high to low, and the reserved mask."""
    names = {"drop_since_last": 7, "fifo_half_full": 6, "fifo_near_full": 5, "spi_crc_err": 4, "spi_timeout": 3, "overflow_sticky": 2}
    return {k: F.shiftright(raw, bit).bitwiseAND(F.lit(1)) == 1 for k, bit in names.items()} | {"reserved_clean": raw.bitwiseAND(F.lit(0b00011011)) == 0}


def crc16(data: Column, length: int | None = None) -> Column:
    """CRC-16/CCITT of the first bytes of a binary column, or of all of them: polynomial 0x1021, from 0xFFFF, no final
    exclusive or."""
    hexed = F.hex(data)
    last = F.octet_length(data) - 1 if length is None else F.lit(length - 1)
    places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).when(last < 0, F.array().cast("array<int>"))

    def byte(i: Column) -> Column:
        return F.conv(F.substring(hexed, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")

    def bit(crc: Column, _: Column) -> Column:
        shifted = F.shiftleft(crc, 1).bitwiseAND(F.lit(0xFFFF))
        return F.when(crc >= 0x8000, shifted.bitwiseXOR(F.lit(0x1021))).otherwise(shifted)

    def step(crc: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), crc.bitwiseXOR(F.shiftleft(byte(i), 8)), bit)

    return F.aggregate(places, F.lit(0xFFFF), step)
