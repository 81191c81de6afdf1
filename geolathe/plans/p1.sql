WITH p AS (
  SELECT DISTINCT id, geometry.x AS x, geometry.y AS y FROM places
  WHERE id IS NOT NULL AND isfinite(geometry.x) AND isfinite(geometry.y) AND NOT (geometry.x = 0 AND geometry.y = 0)
), n AS (
  SELECT DISTINCT osmid, x, y FROM nodes WHERE isfinite(x) AND isfinite(y) AND osmid IS NOT NULL
), z AS (
  SELECT DISTINCT zone_id, geom, list_transform(geom[1], lambda v: v.x) AS xs, list_transform(geom[1], lambda v: v.y) AS ys FROM zones WHERE geom IS NOT NULL
), r AS (
  SELECT zone_id, geom, unnest(generate_series(1, len(geom))) AS ring FROM z
), v AS (
  SELECT zone_id, geom, ring, unnest(generate_series(1, len(geom[ring]))) AS i FROM r
), e AS (
  SELECT zone_id, geom, ring, geom[ring][i].x AS ax, geom[ring][i].y AS ay,
         geom[ring][i % len(geom[ring]) + 1].x AS bx, geom[ring][i % len(geom[ring]) + 1].y AS by FROM v
), c AS (
  SELECT p.id, z.zone_id, z.geom, p.x, p.y FROM p JOIN z
  ON p.x >= list_min(z.xs) AND p.x <= list_max(z.xs) AND p.y >= list_min(z.ys) AND p.y <= list_max(z.ys)
), hit AS (
  SELECT c.id, c.zone_id, c.geom, e.ring, count(*) % 2 AS odd FROM c JOIN e ON c.zone_id = e.zone_id AND c.geom = e.geom
  WHERE (e.ay > c.y) <> (e.by > c.y) AND c.x < (e.bx - e.ax) * (c.y - e.ay) / (e.by - e.ay) + e.ax
  GROUP BY ALL
), held AS (
  SELECT id, zone_id, geom FROM hit GROUP BY ALL HAVING max(CASE WHEN ring = 1 THEN odd ELSE 0 END) = 1 AND max(CASE WHEN ring > 1 THEN odd ELSE 0 END) = 0
)
SELECT DISTINCT p.id AS place_id, 'node' AS near_kind, n.osmid AS near_id FROM p JOIN n
ON n.x >= p.x - 25.1 AND n.x <= p.x + 25.1 AND n.y >= p.y - 25.1 AND n.y <= p.y + 25.1
WHERE (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y) <= 625.0000001
UNION
SELECT DISTINCT id, 'zone', zone_id FROM held
