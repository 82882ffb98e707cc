"""Table schemas. Every table carries ``scene_id``; rings are arrays of points without a closing one."""

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
POINTS = "scene_id string, point_id long, x double, y double, z double, nx double, ny double, nz double, r short, g short, b short, view_id int"
CAMERAS = "scene_id string, view_id int, T array<array<double>>, K array<array<double>>, width int, height int, dist array<double>"
FRAMES = "clip_id string, frame_idx long, time_s double, sharpness double, flatness double, width int, height int, path string, image binary"
VIEWS = "scene_id string, view_id int, h int, w int, depth array<float>, mask array<boolean>, K array<array<double>>, T array<array<double>>"
WALLS = "scene_id string, id int, ax double, ay double, bx double, by double, thickness double, height double, sides_seen int, line_id int, exterior boolean"
OPENINGS = "scene_id string, id int, wall_id int, kind string, t0 double, t1 double, z0 double, z1 double, rooms array<int>, tag string, height_measured boolean"
ROOMS = f"scene_id string, id int, name string, polygon {RING}, holes array<{RING}>, closed boolean, floor_seen double"
PLANS = "scene_id string, ceiling_height double, ceiling_measured boolean, transform array<array<double>>, units string, north_deg double, project map<string,string>, meta string, version int"
BUILDINGS = "id string, source string, footprint array<struct<lon:double,lat:double>>, holes array<array<struct<lon:double,lat:double>>>, height_m double, levels long, roof_shape string, name string, tags map<string,string>, license string, attribution string"
