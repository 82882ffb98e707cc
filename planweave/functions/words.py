"""Words of sheets in two languages, looked up by ``text.label``; an unknown language or word
falls back to English, an unknown key to itself."""

from __future__ import annotations

WORDS: dict[str, dict[str, str]] = {
    "en": {
        "useful": "Useful area", "walls": "Walls", "gross": "Gross area", "door": "door", "window": "window", "passage": "opening", "areas": "AREAS", "openings": "OPENINGS", "notes": "NOTES", "room": "Room", "area": "Area", "perimeter": "Perimeter", "tag": "Tag", "kind": "Kind", "width": "Width",
        "height": "Height", "sill": "Sill", "wall": "Wall", "project": "Project", "sheet": "Sheet", "scale": "Scale", "units": "Units", "north": "N", "stamp": "NOT TO SCALE: the scale is not calibrated", "stamp_chain": "NOT TO SCALE: the scale drifted along the walk", "stamp_unreliable": "NOT RELIABLE: the reconstruction fell apart",
    },
    "es": {
        "useful": "Superficie útil", "walls": "Muros", "gross": "Superficie construida", "door": "puerta", "window": "ventana", "passage": "paso", "areas": "SUPERFICIES", "openings": "HUECOS", "notes": "NOTAS", "room": "Estancia", "area": "Superficie", "perimeter": "Perímetro", "tag": "Marca", "kind": "Tipo", "width": "Ancho",
        "height": "Alto", "sill": "Antepecho", "wall": "Muro", "project": "Proyecto", "sheet": "Plano", "scale": "Escala", "units": "Unidades", "north": "N", "stamp": "SIN ESCALA: la escala no está calibrada", "stamp_chain": "SIN ESCALA: la escala varió durante el recorrido", "stamp_unreliable": "NO FIABLE: la reconstrucción se rompió",
    },
}

MESSAGES_ES = {
    "open_room": "estancias sin contorno cerrado: {items}",
    "no_rooms": "no se encontró ninguna estancia",
    "rooms_overlap": "las estancias comparten {m2} m2 de suelo",
    "opening_orphan": "huecos sin muro: {items}",
    "room_no_way_in": "estancias cerradas sin puerta: {items}",
    "impossible_geometry": "formas imposibles: {items}",
    "sampled_too_sparsely": "se usaron {n} de {total} fotogramas, {rate} por metro cuadrado",
    "too_few_frames": "{n} fotogramas sobre {m2} m2, {rate} por metro cuadrado; se piden {want}",
    "floor_seen": "contornos sobre suelo que no se vio: {items} ({pct} %)",
    "thickness": "{n} de {m} muros tienen un espesor supuesto",
    "ceiling": "no se vio el techo; su altura es la habitual",
    "unreliable": "{bad} de {n} tramos perdieron la escala; se conservó el {cover} % de un fotograma",
    "scale_chain": "en {links} enlaces la escala varió {times} veces",
    "scale": "la escala no está calibrada",
    "door_height": "alturas de puerta supuestas: {items}",
    "no_windows": "no se encontró ninguna ventana",
    "ok": "nada que señalar",
}
