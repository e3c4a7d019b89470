"""Planning defaults.

Fixed values: the vehicle model, spread rates, drop counts and limits that results depend on.
"""

SPEED_MPS, ENDURANCE_MIN, CAPACITY_KG, PER_DROP_KG = 5.0, 7.0, 8.0, 0.25
PAYLOAD_FACTOR, WIND_FACTOR, RESERVE = 0.08, 0.025, 0.20
RAIN_PER_PX, WIND_PER_PX = 5.0, 10.0
DROP_AREAS, MAX_DROPS, MIN_DROP_SPACING = (2000, 8000, 25000), 4, 50.0
MIN_COVERAGE, MAX_COVERAGE = 0.001, 0.50
MIN_AREA, CLEARANCE, MAX_BASES, SEPARATION = 200.0, 5.0, 6, 150.0
ALTITUDE, DROP_ALTITUDE, SERVO_CHANNEL, SERVO_PWM, LOITER_S = 100, 10, 9, 2000, 5
WIND_LIMIT, RAIN_LIMIT = 40.0, 15.0
DEFAULT_LAT, DEFAULT_LON = 25.3176, 82.9739
METRES_PER_DEGREE = 111320.0
CALM = {"precipitation": 0.0, "wind_speed_10m": 0.0, "wind_direction_10m": 0.0, "visibility": 10000.0}
