"""Observed numbers the operators must reproduce (fixed values)."""

# Shares read off the audio histogram.
AUDIO_TARGET = {
    "0-1m": 0.7437746270164686,
    "1-5m": 0.20213734541915146,
    "5-10m": 0.024203360063663838,
    "10-15m": 0.008100716259766091,
    "15-20m": 0.004357014767998277,
    "20-25m": 0.002885370580337969,
    "25-30m": 0.0021900244186080354,
    "0.5-1h": 0.006976163064578965,
    "1-8h": 0.0051660344770954455,
    "8-24h": 0.00020327358195991655,
    ">24h": 0.000006070350371476338,
}

# Counts per bin: everything, before the refresh, and at the best cutoff.
COUNTS_ALL = [18375918, 4997107, 598922, 200531, 107709, 71244, 54050, 171980, 127532, 5013, 154]
COUNTS_REFRESH = [17974238, 4887588, 585436, 195951, 105365, 69727, 52946, 168595, 124959, 4922, 150]
COUNTS_BEST = [17812369, 4840882, 579583, 193986, 104321, 69131, 52490, 167197, 123811, 4878, 144]

SHARES_ALL = [
    0.7436583980030886, 0.20222884028270152, 0.024237884335835947, 0.00811532584167808,
    0.004358895288415777, 0.0028831865111355005, 0.0021873593695872465, 0.006959890182823583,
    0.005161115913454223, 0.0002028720170164823, 6.2322542630237926e-06,
]
SHARES_REFRESH = [
    0.7436627832239279, 0.202218157750658, 0.024221720284302646, 0.008107240264400187,
    0.004359351932159191, 0.002884871942045878, 0.0021905779661187353, 0.006975418203410799,
    0.005170030447403601, 0.000203641913444574, 6.2060721285424825e-06,
]
SHARE_DELTAS = [
    -4.38522083923143e-06, 1.06825320435322e-05, 1.6164051533301e-05, 8.085577277891845e-06,
    -4.5664374341385094e-07, -1.6854309103776603e-06, -3.2185965314888466e-06,
    -1.5528020587215856e-05, -8.914533949378259e-06, -7.698964280917152e-07,
    2.6182134481310007e-08,
]
BEST_SSE = 9.298586669180742e-11
BEST_MAX_ABS = 5.630233666287232e-06
BEST_TOTAL = 23948792

# Squared error and largest difference of two snapshots.
REFRESH_SSE, REFRESH_MAX_ABS = 1.94420212684293332e-08, 0.000111843792540700093
ALL_SSE, ALL_MAX_ABS = 2.35904542777700561e-08, 0.000116229013379931523

# Monthly series: computed value and value shown, 2025-11 to 2026-05.
SERIES_MONTHS = ["2025-11", "2025-12", "2026-01", "2026-02", "2026-03", "2026-04", "2026-05"]
MEAN_GOT = [
    93.36897325747667, 86.97427382951315, 86.34027585396403, 94.42622125358632,
    91.15417328045868, 100.11793456319577, 102.36145133377514,
]
MEAN_TARGET = [
    93.36897325747667, 86.9742738295131, 86.34027585396407, 94.42622125358629,
    91.1541732804587, 100.11793456319575, 102.36145133377522,
]
OLD_MEAN_TARGET = [
    17459.997999148138, 16177.214932289435, 16836.353791522994, 18035.408259434982,
    17683.90961640899, 18922.289632443997, 19653.398656084843,
]

# Monthly tracks and seconds: (month, audio, video, livestream) each.
MONTHLY_TRACKS = [
    ("2025-11", 4710322, 421517, 1056),
    ("2025-12", 4785624, 435140, 1044),
    ("2026-01", 4925224, 490216, 947),
    ("2026-02", 4552469, 454848, 851),
    ("2026-03", 4815902, 494906, 1217),
    ("2026-04", 4841230, 488135, 899),
    ("2026-05", 4578446, 466276, 1007),
]
MONTHLY_SECONDS = [
    (627262886.060711, 37727301.45940144, 360148.45510423183),
    (594437216.0928439, 38003499.12989773, 305748.0316711664),
    (591195487.2551153, 41550423.51438805, 394471.9507666826),
    (591007063.3961097, 37816656.0159933, 265950.2779111862),
    (651551336.416731, 42789908.42229362, 1373796.8904047012),
    (640262383.7137778, 41523602.60008663, 599095.408762455),
    (594237222.3010098, 40141472.41532456, 461608.17931449413),
]
GRAND_TRACKS = (33209217, 3251038, 7021)
GRAND_HOURS = (1191653.7764545272, 77653.57321038481, 1044.6719983152548)

# Counts per month of the six trend sources.
TREND = {
    "audio_recording": [4710322, 4785624, 4925224, 4552469, 4815902, 4841230, 5079778],
    "audio_imports": [144913, 145771, 146302, 150332, 157453, 152681, 159983],
    "audio_exports": [1221707, 1256856, 1277111, 1199625, 1279952, 1238133, 1338526],
    "video_recording": [421517, 435140, 490216, 454848, 494906, 488135, 520630],
    "video_imports": [101068, 102441, 101232, 100055, 109142, 104861, 109796],
    "video_exports": [320861, 319266, 346076, 319343, 347086, 333700, 363976],
}
AUDIO_IMPORT_TOTAL = 1057435
AUDIO_EXPORT_TOTAL = 8811910

# Ready-made fine bins under one minute.
VIDEO_FINE = [37896, 277523, 239918, 190954, 161168, 140969, 125985, 112232, 101867, 94666, 59862]
AUDIO_FINE = [
    527650, 5043406, 3364059, 2190308, 1648254, 1318596, 1083774, 900785, 760087, 660483, 391367,
]
