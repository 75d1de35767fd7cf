"""Fixed values of the sensor hardware and its wire protocol.

Everything in this module is data: names, codes, rates and defaults that the
devices and the stored formats dictate.  Nothing here computes a result.
"""

from __future__ import annotations

# --- fixed values: framing -------------------------------------------------
BASE_STATION_ID = "base-station"
PACKET_KEY = 254
PACKET_KEY_OFFSET = 245
HANDLE_DEFINITION_TYPE = 255
FULL_PACKET_BYTES = 244
NODE_CLOCK_OFFSET = 240
NODE_CLOCK_HZ = 65536.0
CLOCK_HISTORY = 10

# --- fixed values: packet names, in handle order (start + 2, start + 4, ...) -
PACKET_NAMES = [
    "Abs. baros",
    "Diff. baros",
    "Mic 0",
    "Mic 1",
    "IMU Accel",
    "IMU Gyro",
    "IMU Magnetometer",
    "Analog1",
    "Analog2",
    "Constat",
    "Cmd Decline",
    "Sleep State",
    "Remote Info Message",
    "Timestamp Packet 0",
    "Timestamp Packet 1",
    "Local Info Message",
]
CONSTAT = "Constat"
DEFAULT_NODE_HANDLE_START = 32
EXPECTED_HANDLE_SPAN = 30
CONSTAT_HANDLE_DISTANCE = 2 * (PACKET_NAMES.index(CONSTAT) + 1)
DEFAULT_GATEWAY_HANDLES = {64: "Local Info Message"}
DEFAULT_NODE_HANDLES = {DEFAULT_NODE_HANDLE_START + 2 * (i + 1): name for i, name in enumerate(PACKET_NAMES)}

# --- fixed values: what happens to each packet name -------------------------
TICK_PACKETS = ["Timestamp Packet 0", "Timestamp Packet 1"]
UNSUPPORTED_PACKETS = ["Analog1", "Analog2", "Analog Kinetron"]
REMOTE_INFO_PACKETS = ["Mic 1", "Cmd Decline", "Sleep State", "Remote Info Message"]
LOCAL_INFO_PACKET = "Local Info Message"

# --- fixed values: message codes ---------------------------------------------
DECLINE_REASONS = {
    0: "Bad block detection ongoing",
    1: "Task already registered, cannot register again",
    2: "Task is not registered, cannot de-register",
    3: "Connection parameter update unfinished",
    4: "Not ready to sleep",
    5: "Not in sleep",
}
SLEEP_STATES = {0: "Exiting sleep", 1: "Entering sleep"}
FLASH_STATES = {1: "Sensor reading from flash done", 2: "Flash erasing done", 3: "Sensor started"}
REMOTE_INFO_TYPES = {0: "Battery info", 1: "Status feedback"}
LOCAL_INFO_TYPES = {
    0: "Synchronization not ready as not every sensor node is connected",
    1: "Time synchronization info",
    2: "Time sync exception",
    4: "Time sync coarse data record error",
    8: "Time sync alignment error",
    16: "Time sync coarse data time diff error",
    32: "Device not connected",
    64: "Select message destination successful",
    128: "Time sync success",
    129: "Coarse sync finish",
    130: "Time sync msg sent",
    240: "Command not registered",
}
BATTERY_INFO = "Battery info"
TIME_SYNC_INFO = "Time synchronization info"

# --- fixed values: sensors ----------------------------------------------------
# name -> (channels, samples per packet, conversion constant, warehouse type reference)
SENSORS = {
    "Mics": (10, 8, 1.0, "microphone"),
    "Baros_P": (40, 1, 40.96, "barometer"),
    "Baros_T": (40, 1, 100.0, "barometer_thermometer"),
    "Diff_Baros": (5, 24, 1.0, "differential_barometer"),
    "Acc": (3, 40, 1.0, "accelerometer"),
    "Gyro": (3, 40, 1.0, "gyroscope"),
    "Mag": (3, 40, 1.0, "magnetometer"),
    "Analog Vbat": (2, 60, 1.0, "battery_voltmeter"),
    "Constat": (4, 24, 1.0, "connection_statistics"),
    "battery_info": (3, 1, 1.0, "battery_info"),
}
MICROPHONE = "Mics"
SENSOR_NAMES = list(SENSORS)
NUMBER_OF_SENSORS = {name: row[0] for name, row in SENSORS.items()}
SAMPLES_PER_PACKET = {name: row[1] for name, row in SENSORS.items()}
CONVERSION_CONSTANTS = {name: row[2] for name, row in SENSORS.items()}
SENSOR_TYPE_REFERENCES = {name: row[3] for name, row in SENSORS.items()}
IMU_SENSORS = ["Acc", "Gyro", "Mag"]

# sensor -> (node configuration field, how the field turns into a period in seconds)
PERIOD_FIELDS = {
    "Mics": ("mics_freq", "hertz"),
    "Baros_P": ("baros_freq", "hertz"),
    "Baros_T": ("baros_freq", "hertz"),
    "Diff_Baros": ("diff_baros_freq", "hertz"),
    "Acc": ("acc_freq", "hertz"),
    "Gyro": ("gyro_freq", "hertz"),
    "Mag": ("mag_freq", "hertz"),
    "Analog Vbat": ("analog_freq", "hertz"),
    "Constat": ("constat_period", "milliseconds"),
    "battery_info": ("battery_info_period", "seconds"),
}

# --- fixed values: configuration defaults ---------------------------------------
GATEWAY_DEFAULTS = {
    "baudrate": 2300000,
    "endian": "little",
    "installation_reference": "unknown",
    "latitude": 0.0,
    "longitude": 0.0,
    "packet_key": PACKET_KEY,
    "packet_key_offset": PACKET_KEY_OFFSET,
    "receiver_firmware_version": "unknown",
    "serial_buffer_rx_size": 4095,
    "serial_buffer_tx_size": 1280,
    "turbine_id": "unknown",
}
NODE_DEFAULTS = {
    "acc_freq": 100.0,
    "acc_range": 16.0,
    "analog_freq": 16384.0,
    "baros_bm": 1023,
    "baros_freq": 100.0,
    "blade_id": "unknown",
    "constat_period": 45.0,
    "battery_info_period": 3600.0,
    "diff_baros_freq": 1000.0,
    "gyro_freq": 100.0,
    "gyro_range": 2000.0,
    "mag_freq": 12.5,
    "mics_freq": 15625.0,
    "mics_bm": 1023,
    "max_timestamp_slack": 0.005,
    "max_period_drift": 0.02,
    "node_firmware_version": "unknown",
}
SENSOR_COMMANDS = {
    "start": ["startBaros", "startDiffBaros", "startIMU", "startMics"],
    "stop": ["stopBaros", "stopDiffBaros", "stopIMU", "stopMics"],
    "configuration": ["configBaros", "configAccel", "configGyro", "configMics"],
    "utilities": [
        "getBattery",
        "setConnInterval",
        "tpcBoostIncrease",
        "tpcBoostDecrease",
        "tpcBoostHeapMemThr1",
        "tpcBoostHeapMemThr2",
        "tpcBoostHeapMemThr4",
    ],
}


def default_periods() -> dict[str, float]:
    """Seconds between two samples of each sensor with default rates."""
    to_seconds = {"hertz": lambda v: 1 / v, "milliseconds": lambda v: v / 1000, "seconds": float}
    return {name: to_seconds[kind](NODE_DEFAULTS[field]) for name, (field, kind) in PERIOD_FIELDS.items()}
